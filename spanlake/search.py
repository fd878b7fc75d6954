"""Searching an index: matches, counts, ranked rows, scores, highlights, and SQL registration."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake import ship, ship_active
from spanlake.functions.analysis import Analyzer, AnalyzerSpec, builtin_stop_words, token_column
from spanlake.operators import evaluate as _evaluate
from spanlake.operators import highlight as _highlight
from spanlake.operators import score as _score
from spanlake.operators.compile import Plan, matching
from spanlake.plans.parser import QueryError, maybe_quote
from spanlake.plans.query import compile_query, prune, ql_parse
from spanlake.sources.index import Index
from spanlake.sources.scratch import shared_dir

VERSION = "0.1.0"


# ------------------------------------------------------------------- matching
def match(index: Index, *queries: str | None, implicit: str = "and") -> DataFrame:
    """doc_id of the documents that match all queries (several clauses: AND); a null query matches none.

    implicit: what white space between operands means, and or or.
    """
    if any(q is None for q in queries):
        return index.docs.select("doc_id").where(F.lit(False))
    parts = [compile_query(q, index.analyzer, implicit=implicit) for q in queries]
    return matching(index, parts[0] if len(parts) == 1 else ("conj", parts))


def match_any(index: Index, queries: list[str | None] | None) -> DataFrame:
    """document ==> ANY(queries): null elements are ignored, an empty list matches none."""
    parts = [compile_query(q, index.analyzer) for q in queries or [] if q is not None]
    if not parts:
        return index.docs.select("doc_id").where(F.lit(False))
    return matching(index, ("disj", 1, parts))


def span_freq(index: Index, query: str) -> DataFrame:
    """doc_id, freq: how many minimal intervals a span query has in each document that matches."""
    q = prune(compile_query(query, index.analyzer))
    if q[0] == "term":
        q = ("span", ("leaf", q))
    if q[0] != "span":
        raise QueryError("span_freq needs a span or a word")
    return Plan(index, q).frequencies()


def count(index: Index, query: str) -> int:
    """Exact number of matching live documents; one word's comes from the dictionary where nothing is dead."""
    q = compile_query(query, index.analyzer)
    if q[0] == "term" and not index.meta.get("dead"):
        return index.frequencies([q[1]]).get(q[1], 0)
    if q == ("all",) and not index.meta.get("dead"):
        return index.totals[0]
    return matching(index, q).count()


def search(index: Index, query: str, limit: int | None = 10, offset: int = 0, snippet: str = "html", begin_tag: str = "<b>", end_tag: str = "</b>", k1: float = 1.2, b: float = 0.75,
           source: DataFrame | None = None, id_col: str = "doc_id", where: Column | str | None = None, full: bool = True) -> DataFrame:
    """doc_id, score, snippet of the best matches, ties by doc_id.

    snippet: html or ansi (from source, which has the texts; null without) or none.
    where filters source's rows before the limit, so the limit is still filled.
    limit 0 checks the query and returns nothing; None returns every match.
    """
    if query is None or limit is not None and limit < 0 or offset < 0:
        raise QueryError("search needs a query, a limit and an offset that aren't negative")
    if snippet not in ("html", "ansi", "none"):
        raise QueryError("snippet must be html, ansi or none")
    if limit is None or where is not None:
        ranked = _score.scores(index, query, full=full, k1=k1, b=b)
    else:
        ranked = _score.top_scores(index, query, offset + limit, full, k1, b)
    if where is not None:
        ok = source.where(where).select(F.col(id_col).alias("doc_id"))
        ranked = ranked.join(ok, "doc_id", "left_semi")
    ranked = ranked.orderBy(F.desc("score"), "doc_id")
    if offset:
        ranked = ranked.offset(offset)
    if limit is not None:
        ranked = ranked.limit(limit)
    if snippet == "none" or source is None:
        return ranked.withColumn("snippet", F.lit(None).cast("string"))
    texts = source.select(F.col(id_col).alias("doc_id"), *index.fields)
    return ranked.join(texts, "doc_id").select("doc_id", "score", snippet_column(index, query, snippet, begin_tag, end_tag).alias("snippet")).orderBy(F.desc("score"), "doc_id")


def scores(index: Index, query: str, **options) -> DataFrame:
    """score(): dense terms and stop words don't count (dense_ratio, term_add, term_replace, score_stop_words, k1, b)."""
    return _score.scores(index, query, full=False, **options)


def clause_scores(index: Index, *queries: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Several clauses on one column: the documents that match all, scored as one query of all their words."""
    return _score.scores_of_all(index, list(queries), k1, b)


def full_scores(index: Index, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """full_score(): every query term counts."""
    return _score.scores(index, query, full=True, k1=k1, b=b)


def with_max_score(scored: DataFrame) -> DataFrame:
    """Adds max_score, the best score of the query, to every row."""
    best = scored.agg(F.max("score").alias("max_score"))
    return scored.crossJoin(F.broadcast(best))  # one row


def multi_column_scores(parts: list[tuple[Index, str]]) -> DataFrame:
    """Documents that match every (index, query), with the sum of their scores in clause order."""
    out = None
    for k, (index, query) in enumerate(parts):
        one = full_scores(index, query).withColumnRenamed("score", f"s{k}")
        out = one if out is None else out.join(one, "doc_id")
    total = reduce(lambda a, b: (a + b).cast("float"), (F.col(f"s{k}") for k in range(len(parts))))
    return out.select("doc_id", total.alias("score"))


def top_k_per(outer: DataFrame, index: Index, query_col: str, k: int, key_cols: list[str], block: int = 100) -> DataFrame:
    """For every row of outer the k best documents of its query: each different query is planned once, `block` of them in a job.

    Results of the blocks, k rows a query, go to the shared folder.
    """
    path, made = f"{shared_dir(index.spark)}/topk-{uuid.uuid4().hex}", False
    queries = (r[0] for r in outer.select(query_col).where(F.col(query_col).isNotNull()).distinct().toLocalIterator())
    while part := sorted(islice(queries, block)):
        best = [search(index, q, limit=k, snippet="none").select(F.lit(q).alias(query_col), "doc_id", "score") for q in part]
        reduce(DataFrame.unionByName, best).write.mode("append").parquet(path)
        made = True
    if not made:
        return outer.select(*key_cols).limit(0).select("*", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("float").alias("score"), F.lit(0).alias("rank"))
    rank = F.row_number().over(Window.partitionBy(query_col).orderBy(F.desc("score"), "doc_id"))  # k rows each
    return outer.select(query_col, *key_cols).join(index.spark.read.parquet(path).withColumn("rank", rank), query_col).select(*key_cols, "doc_id", "score", "rank")


# ------------------------------------------------------------------ highlights
def snippet_column(index: Index, query: str, kind: str = "html", begin: str = "<b>", end: str = "</b>", field: str | None = None) -> Column:
    """Snippet of the index's text columns: the given field, else the first with a mark, else the first not null."""
    ship_active()
    fields, analyzer = index.fields, index.analyzer
    if field is not None and field not in fields:
        raise QueryError(f"unknown field {field!r}")

    @F.pandas_udf("string")
    def make(texts: pd.DataFrame) -> pd.Series:
        def one(row):
            first = None
            for name, text in zip(fields, row):
                if text is None or field not in (None, name):
                    continue
                done = _highlight.highlight(text, begin, end, query, analyzer, name) if kind == "html" else _highlight.highlight_ansi(text, None, query, analyzer, name)
                if done != text:
                    return done
                first = text if first is None else first
            return first

        return pd.Series([one(row) for row in zip(*(texts[c] for c in texts))], dtype=object)

    return make(F.struct(*index.fields))


def hits(index: Index, source: DataFrame, *queries: str, id_col: str = "doc_id", kind: str = "html", begin: str = "<b>", end: str = "</b>", field: str | None = None) -> DataFrame:
    """Rows of source that match all queries, with snippet: their text marked by the same queries and the index's own analysis."""
    bound = " OR ".join(f"({q})" for q in queries)
    found = match(index, *queries).select(F.col("doc_id").alias("found_id"))
    rows = source.join(found, source[id_col] == F.col("found_id"), "left_semi")
    return rows.withColumn("snippet", snippet_column(index, bound, kind, begin, end, field))


def highlight_column(text: Column, query: str | None, begin: str = "<b>", end: str = "</b>", spec: AnalyzerSpec | None = None) -> Column:
    ship_active()
    analyzer = Analyzer(spec)

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _highlight.highlight(t, begin, end, query, analyzer))

    return make(text)


def highlight_ansi_column(text: Column, query: str | None, wrap_to: int | None = None, spec: AnalyzerSpec | None = None) -> Column:
    ship_active()
    if wrap_to is not None and wrap_to <= 0:
        raise QueryError("wrap_to must be positive")
    analyzer = Analyzer(spec)

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _highlight.highlight_ansi(t, wrap_to, query, analyzer))

    return make(text)


# ---------------------------------------------------- without an index, and SQL
def matches_column(text: Column, query: str, spec: AnalyzerSpec | None = None) -> Column:
    """text ==> query, row by row; null texts give null."""
    ship_active()
    analyzer = Analyzer(spec)
    q = compile_query(query, analyzer)

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else _evaluate.evaluate(q, _evaluate.Doc.of({"body": t}, analyzer)) for x in texts), pa.bool_())

    return run(text)


def tokenize(df: DataFrame, text_col: str, spec: AnalyzerSpec | None = None) -> DataFrame:
    """One row per token: df's columns, token, pos."""
    return df.withColumn("__t", F.explode(token_column(F.col(text_col), spec))).select(*df.columns, F.col("__t.text").alias("token"), F.col("__t.pos").alias("pos"))


def stop_word_table(spark: SparkSession, preset: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in builtin_stop_words(preset)], "word string")


def capabilities() -> str:
    """A JSON document of what this version does."""
    return json.dumps({
        "version": VERSION, "tokenizers": ["unicode", "whitespace", "dictionary"], "scoring": ["bm25", "weighted multi-field bm25"], "snippets": ["html", "ansi", "none"],
        "language": ["term", "phrase", "gap", "slop", "and", "or", "and not", "alternatives", "at least", "all of", "then", "near", "within", "relations", "positional filters", "wildcard", "regex", "fuzzy", "range", "boost", "field scope"],
        "max_expansion_terms": 65536, "max_fields": 16,
    }, sort_keys=True)


def register(spark: SparkSession) -> None:
    """SQL functions: ql_matches, ql_highlight, ql_highlight_ansi, ql_tokenize, ql_maybe_quote, ql_parse, ql_capabilities, ql_version."""
    ship(spark)
    a = Analyzer()

    @F.pandas_udf("boolean")
    def ql_matches(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([_evaluate.matches(t, q, a) for t, q in zip(text, query)], dtype=object)

    @F.pandas_udf("string")
    def ql_highlight(text: pd.Series, begin: pd.Series, end: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([_highlight.highlight(t, x, y, q, a) for t, x, y, q in zip(text, begin, end, query)], dtype=object)

    @F.pandas_udf("string")
    def ql_highlight_ansi(text: pd.Series, wrap_to: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([_highlight.highlight_ansi(t, None if pd.isna(w) else int(w), q, a) for t, w, q in zip(text, wrap_to, query)], dtype=object)

    @F.pandas_udf("array<string>")
    def ql_tokenize(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else a.terms(t))

    @F.pandas_udf("string")
    def ql_maybe_quote(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else maybe_quote(t))

    @F.pandas_udf("string")
    def ql_lowered(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else ql_parse(t))

    for name, f in {"ql_matches": ql_matches, "ql_highlight": ql_highlight, "ql_highlight_ansi": ql_highlight_ansi, "ql_tokenize": ql_tokenize, "ql_maybe_quote": ql_maybe_quote, "ql_parse": ql_lowered}.items():
        spark.udf.register(name, f)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ql_version() RETURNS STRING RETURN '{VERSION}'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ql_capabilities() RETURNS STRING RETURN '{capabilities()}'")


def correlated(df: DataFrame, text_col: str, query_col: str, spec: AnalyzerSpec | None = None) -> Column:
    """text ==> query where the query is a column of the row."""
    ship_active()
    a = Analyzer(spec)

    @F.pandas_udf("boolean")
    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([_evaluate.matches(t, q, a) for t, q in zip(text, query)], dtype=object)

    return run(df[text_col], df[query_col])
