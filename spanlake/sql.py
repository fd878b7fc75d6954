"""Table functions of the search engine in SQL text.

Spark plans a table function without seeing other tables, so a search can't be one
of its own: sql() finds calls in a statement, plans each as a DataFrame and puts a
temporary view in its place.  Arguments are literals, by place or `name => value`.

  matches(index, query, ...)            doc_id
  search(index, query, [limit, offset, snippet, begin_tag, end_tag, k1, b])   doc_id, score, snippet
  score_table(index, query) / full_score_table(index, query)    doc_id, score
  score_inspect(index, query)           term, weight
  tokenize(text) / tokenize(index, text)                        token, pos, start, end, kind
  segment_info(index)  index_stats(index)  index_analysis(index)  verify_index(index)
  builtin_stop_words(preset)            word
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import search as S
from spanlake.functions.analysis import token_spans
from spanlake.operators.score import inspect
from spanlake.plans.parser import QueryError
from spanlake.sources.index import Index

_named: dict[tuple[str, str], tuple[Index, DataFrame | None, str]] = {}


def name_index(name: str, index: Index, source: DataFrame | None = None, id_col: str = "doc_id") -> None:
    """Make an index known to sql() under a name; source has the rows, for snippets and verify_index."""
    _named[(index.spark.sparkContext.applicationId, name)] = (index, source, id_col)


def _known(spark: SparkSession, name: str):
    held = _named.get((spark.sparkContext.applicationId, name))
    if held is None:
        raise QueryError(f"no index is named {name!r}")
    return held


def _tokens(spark, first, text=None):
    spec = _known(spark, first)[0].analyzer.spec if text is not None else None
    rows = spark.createDataFrame([(first if text is None else text,)], "t string")
    return rows.select(F.explode(token_spans(F.col("t"), spec)).alias("x")).select(F.col("x.text").alias("token"), "x.pos", "x.start", "x.end", "x.kind")


def _search(spark, name, query, limit=10, offset=0, snippet="html", begin_tag="<b>", end_tag="</b>", k1=1.2, b=0.75):
    index, source, id_col = _known(spark, name)
    return S.search(index, query, limit, offset, snippet, begin_tag, end_tag, k1, b, source=source, id_col=id_col)


def _verified(spark, name):
    index, source, id_col = _known(spark, name)
    return index.verify(source, id_col)


def _ix(spark, name) -> Index:
    return _known(spark, name)[0]


FUNCTIONS = {
    "matches": lambda spark, name, *queries: S.match(_ix(spark, name), *queries),
    "search": _search,
    "score_table": lambda spark, name, query, **edits: S.scores(_ix(spark, name), query, **edits),
    "full_score_table": lambda spark, name, query, **k: S.full_scores(_ix(spark, name), query, **k),
    "score_inspect": lambda spark, name, query, **edits: inspect(_ix(spark, name), query, **edits),
    "tokenize": _tokens,
    "segment_info": lambda spark, name: _ix(spark, name).segment_info(),
    "index_stats": lambda spark, name: _ix(spark, name).index_stats(),
    "index_analysis": lambda spark, name: _ix(spark, name).index_analysis(),
    "verify_index": _verified,
    "builtin_stop_words": lambda spark, preset: S.stop_word_table(spark, preset),
}

_SKIP = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_CALL = re.compile(r"(?<![\w.])(" + "|".join(FUNCTIONS) + r")\s*\(", re.I)
_ARGUMENT = re.compile(r"\s*(?:([a-z_][a-z0-9_]*)\s*=>\s*)?(?:'((?:[^']|'')*)'|(-?[0-9]+(?:\.[0-9]+)?)|(null|true|false))\s*([,)])", re.I)
_TABLE = re.compile(r"(?:\b(?:from|join|lateral)|,)\s*$", re.I)


def _arguments(text: str, at: int) -> tuple[list, dict, int] | None:
    """Literal arguments from behind the opening parenthesis to behind the closing one; None if there is anything else."""
    places, names = [], {}
    if m := re.compile(r"\s*\)").match(text, at):
        return places, names, m.end()
    while m := _ARGUMENT.match(text, at):
        name, string, number, word, end = m.groups()
        value = string.replace("''", "'") if string is not None else (float(number) if "." in number else int(number)) if number else {"null": None, "true": True, "false": False}[word.lower()]
        if name:
            names[name.lower()] = value
        else:
            places.append(value)
        at = m.end()
        if end == ")":
            return places, names, at
    return None


def sql(spark: SparkSession, statement: str) -> DataFrame:
    """spark.sql with this module's table functions, wherever a table may stand."""
    out, at = [], 0
    while at < len(statement):
        call, skip = _CALL.search(statement, at), _SKIP.search(statement, at)
        if skip and (not call or skip.start() < call.start()):
            out.append(statement[at:skip.end()])
            at = skip.end()
            continue
        if not call:
            break
        before = "".join(out) + statement[at:call.start()]
        given = _arguments(statement, call.end()) if _TABLE.search(before) else None
        if given is None:
            out.append(statement[at:call.end()])
            at = call.end()
            continue
        places, names, end = given
        try:
            table = FUNCTIONS[call[1].lower()](spark, *places, **names)
        except TypeError as e:
            raise QueryError(f"{call[1]}: {e}") from None
        view = f"spanlake_{uuid.uuid4().hex}"
        table.createOrReplaceTempView(view)
        out.append(statement[at:call.start()] + view)
        at = end
    return spark.sql("".join(out) + statement[at:])
