"""Every operator as a query over the test tables, with the SQL that must give the same rows.

The SQL side tokenises with regular expressions and computes each operator from
its definition; it shares nothing with the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake import search as S
from spanlake.functions.analysis import token_column
from spanlake.sources.index import Index

_built: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index_of(spark: SparkSession, sf_dir: str, name: str = "documents", fields=("text",), id_col: str = "doc_id", **options) -> Index:
    """The index of a table, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name, tuple(fields), str(sorted(options.items())))
    if key not in _built:
        _built[key] = Index.build(table(spark, sf_dir, name), list(fields), id_col, **options)
    return _built[key]


QUERIES: dict = {}
SQL: dict[str, str] = {}

# ------------------------------------------------------------------ SQL pieces
def _tokens(source: str, id_col: str = "doc_id", text: str = "text") -> str:
    """CTE tok(doc_id, t, p): folded tokens and their positions."""
    marked = f"strip_accents(lower({text}))"
    for _ in range(2):  # twice: matches may share a character
        for a, b in ((".", ""), (":", ""), ("''", "")):
            marked = f"regexp_replace({marked}, '(\\p{{L}})[{a}](\\p{{L}})', '\\1{b}\\2', 'g')"
        for a, b in ((".", ""), (",", ""), (";", ""), ("''", "")):
            marked = f"regexp_replace({marked}, '([0-9])[{a}]([0-9])', '\\1{b}\\2', 'g')"
    return f"""
raw AS (SELECT {id_col} AS doc_id, list_filter(regexp_extract_all({marked}, '[\\p{{L}}0-9_-]+'), lambda x: regexp_matches(x, '[\\p{{L}}0-9]')) AS ts FROM {source}),
tok AS (SELECT doc_id, translate(unnest(ts), '', '.:'',;') AS t, unnest(range(len(ts))) AS p FROM raw),
dl AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)"""


TOK = "WITH " + _tokens("documents")


def _having(cond: str) -> str:
    return f"{TOK} SELECT doc_id FROM tok GROUP BY doc_id HAVING {cond}"


def _has(word: str) -> str:
    return f"bool_or(t = '{word}')"


def _pairs(a: str, b: str, on: str) -> str:
    return f"{TOK} SELECT DISTINCT x.doc_id FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.t = '{a}' AND y.t = '{b}' AND {on}"


def _bm25(words: list[tuple[str, float]] | str, match: str, extra: str = "") -> str:
    """CTEs up to sc(doc_id, score): bit-exact single-precision scores of the documents in `match`."""
    steps = (31288, 14938, 7132, 3405, 1626, 777, 371, 177, 85, 41, 20, 10, 5, 3, 2, 1)
    rep = "CASE " + " ".join(f"WHEN count(*) >= {s} THEN {s}" for s in steps) + " END"
    names = words if isinstance(words, str) else "SELECT * FROM (VALUES " + ", ".join(f"('{w}', CAST({x} AS FLOAT))" for w, x in words) + ") v(t, boost)"
    return f"""{TOK},
hit AS ({match}),
w AS (SELECT t, boost FROM ({names}) v(t, boost)),
st AS (SELECT count(*) AS n, CAST(CAST(sum(n) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) AS avgdl FROM dl),
df AS (SELECT t, count(DISTINCT doc_id) AS df FROM tok WHERE t IN (SELECT t FROM w) GROUP BY t),
m AS (SELECT t, CAST(CAST(greatest(0, ln(1 + (st.n - df + 0.5) / (df + 0.5))) AS FLOAT) * boost AS FLOAT) AS mult FROM df JOIN w USING (t), st),
tf AS (SELECT doc_id, t, CAST({rep} AS FLOAT) AS tf FROM tok WHERE t IN (SELECT t FROM w) GROUP BY doc_id, t),
k AS (SELECT CAST(1.2 AS FLOAT) AS k1, CAST(0.75 AS FLOAT) AS b),
pt AS (SELECT doc_id, t, CAST(CAST(CAST(mult * tf AS FLOAT) * CAST(k1 + CAST(1 AS FLOAT) AS FLOAT) AS FLOAT)
  / CAST(CAST(tf + CAST(k1 * CAST(CAST(1 AS FLOAT) - b AS FLOAT) AS FLOAT) AS FLOAT) + CAST(CAST(CAST(k1 * b AS FLOAT) / avgdl AS FLOAT) * CAST(dl.n AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT) AS s
  FROM tf JOIN m USING (t) JOIN dl USING (doc_id), st, k),
su AS (SELECT doc_id, list_reduce(list(s ORDER BY t), lambda a, b: CAST(a + b AS FLOAT)) AS s FROM pt GROUP BY doc_id),
sc AS (SELECT hit.doc_id, coalesce(su.s, CAST(0 AS FLOAT)) AS score FROM hit LEFT JOIN su USING (doc_id)){extra}"""


def _any(*words: str) -> str:
    return f"SELECT DISTINCT doc_id FROM tok WHERE t IN ({', '.join(repr(w) for w in words)})"


# ---------------------------------------------------------------- registration
def _match(name: str, query: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: S.match(index_of(spark, sf_dir), query)
    SQL[name] = sql


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return keep


# Boolean operators
_match("q01_term", "trash", _having(_has("trash")))
_match("q02_contains", "CONTAINS Clown", _having(_has("clown")))
_match("q03_match_all", "*", f"{TOK} SELECT doc_id FROM dl")
_match("q04_match_none", "!!!", f"{TOK} SELECT doc_id FROM dl WHERE false")
_match("q05_wildcard", "worth*", _having("bool_or(t LIKE 'worth%')"))
_match("q05_wildcard_inside", "tr?sh OR *iot", _having("bool_or(regexp_full_match(t, 'tr.sh')) OR bool_or(t LIKE '%iot')"))
_match("q06_regex", "MATCHES (scum|los(er|t))", _having("bool_or(regexp_full_match(t, 'scum|los(er|t)'))"))
_match("q07_fuzzy", "trsh~1 OR stupd~2:1", _having("bool_or(t[1] = 't' AND levenshtein(t[2:], 'rsh') <= 1) OR bool_or(t[1:2] = 'st' AND levenshtein(t[3:], 'upd') <= 1)"))
_match("q08_range", "idi TO idle", _having("bool_or(t BETWEEN 'idi' AND 'idle')"))
_match("q08_range_open", "zuz TO *", _having("bool_or(t >= 'zuz')"))
_match("q09_phrase", '"of the"', _pairs("of", "the", "y.p = x.p + 1"))
_match("q10_phrase_gap", '"of _ the"', _pairs("of", "the", "y.p = x.p + 2 WHERE NOT EXISTS (SELECT 1 FROM tok z WHERE z.doc_id = x.doc_id AND z.p = x.p + 1 AND z.t IN ('of', 'the'))"))
_match("q11_phrase_slop", '"of the"~3', _pairs("of", "the", "y.p BETWEEN x.p + 1 AND x.p + 4"))
_match("q12_phrase_alternatives", '"[of for] the"', f"{TOK} SELECT DISTINCT x.doc_id FROM tok x JOIN tok y USING (doc_id) WHERE x.t IN ('of', 'for') AND y.t = 'the' AND y.p = x.p + 1")
_match("q14_and", "trash AND idiot", _having(f"{_has('trash')} AND {_has('idiot')}"))
_match("q14_and_implicit", "trash idiot", _having(f"{_has('trash')} AND {_has('idiot')}"))
_match("q15_or", "trash OR und", _having(f"{_has('trash')} OR {_has('und')}"))
_match("q16_and_not", "trash AND NOT idiot", _having(f"{_has('trash')} AND NOT {_has('idiot')}"))
_match("q16_all_and_not", "* AND NOT the", _having(f"NOT {_has('the')}"))
_match("q17_group", "(trash OR clown) AND moron", _having(f"({_has('trash')} OR {_has('clown')}) AND {_has('moron')}"))
_match("q18_alternatives", "[trash, clown moron]", _having(" OR ".join(map(_has, ("trash", "clown", "moron")))))
_match("q19_at_least", "AT LEAST 2 OF [trash clown moron scum]", _having(" + ".join(f"CAST({_has(w)} AS INT)" for w in ("trash", "clown", "moron", "scum")) + " >= 2"))
_match("q19_at_least_percent", "AT LEAST 51% OF [trash clown moron scum]", _having(" + ".join(f"CAST({_has(w)} AS INT)" for w in ("trash", "clown", "moron", "scum")) + " >= 3"))
_match("q20_all_of", "ALL OF [the of thing]", _having(" AND ".join(map(_has, ("the", "of", "thing")))))
# Proximity and span relations
_match("q21_then", "of THEN/2 the", _pairs("of", "the", "y.p BETWEEN x.p + 1 AND x.p + 3"))
_match("q22_near", "and NEAR/1 the", _pairs("and", "the", "abs(x.p - y.p) BETWEEN 1 AND 2"))
_match("q30_before", "und BEFORE der", _pairs("und", "der", "y.p > x.p"))
_match("q31_after", "trash AFTER idiot", _pairs("trash", "idiot", "y.p < x.p"))
_match("q32_in_first", "the IN FIRST 5 WORDS", _having("bool_or(t = 'the' AND p < 5)"))
_match("q32_in_first_percent", "the IN FIRST 2%", f"{TOK} SELECT DISTINCT doc_id FROM tok JOIN dl USING (doc_id) WHERE t = 'the' AND p < ceil(n * 2 / 100)")
_match("q33_in_last", "the IN LAST 5 WORDS", f"{TOK} SELECT DISTINCT doc_id FROM tok JOIN dl USING (doc_id) WHERE t = 'the' AND p >= n - 5")
_match("q34_in_middle", "the IN MIDDLE 10%", f"{TOK} SELECT DISTINCT doc_id FROM tok JOIN dl USING (doc_id) WHERE t = 'the' AND p BETWEEN ceil(n * 90 / 200) AND n - ceil(n * 90 / 200) - 1")
_match("q35_in_words", "the IN WORDS 3 TO 9", _having("bool_or(t = 'the' AND p BETWEEN 2 AND 8)"))
_match("q36_boost_matches", "trash^0 OR clown^5", _having(f"{_has('trash')} OR {_has('clown')}"))

#: Minimal intervals of `and NEAR/4 the`: neighbours of different words among the places of both.
_NEAR = f"""{TOK},
ab AS (SELECT doc_id, p, t, lag(p) OVER o AS q, lag(t) OVER o AS u FROM tok WHERE t IN ('and', 'the') WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
iv AS (SELECT doc_id, q AS a, p AS b FROM ab WHERE u <> t AND p - q - 1 <= 4),
c AS (SELECT doc_id, p FROM tok WHERE t = 'of')"""
_match("q23_within", "(and NEAR/4 the) WITHIN 4", f"{_NEAR} SELECT DISTINCT doc_id FROM iv WHERE b - a + 1 <= 4")
_match("q24_encloses", "(and NEAR/4 the) ENCLOSES of", f"{_NEAR} SELECT DISTINCT iv.doc_id FROM iv JOIN c ON c.doc_id = iv.doc_id AND c.p BETWEEN a AND b")
_match("q25_not_encloses", "(and NEAR/4 the) NOT ENCLOSES of", f"{_NEAR} SELECT DISTINCT doc_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = iv.doc_id AND c.p BETWEEN a AND b)")
_match("q26_enclosed_by", "of ENCLOSED BY (and NEAR/4 the)", f"{_NEAR} SELECT DISTINCT c.doc_id FROM c JOIN iv ON c.doc_id = iv.doc_id AND c.p BETWEEN a AND b")
_match("q27_not_enclosed_by", "of NOT ENCLOSED BY (and NEAR/4 the)", f"{_NEAR} SELECT DISTINCT doc_id FROM c WHERE NOT EXISTS (SELECT 1 FROM iv WHERE c.doc_id = iv.doc_id AND c.p BETWEEN a AND b)")
_match("q28_overlapping", "(and NEAR/4 the) OVERLAPPING of", f"{_NEAR} SELECT DISTINCT iv.doc_id FROM iv JOIN c ON c.doc_id = iv.doc_id AND c.p BETWEEN a AND b")
_match("q29_not_overlapping", "(and NEAR/4 the) NOT OVERLAPPING of", f"{_NEAR} SELECT DISTINCT doc_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = iv.doc_id AND c.p BETWEEN a AND b)")
_match("q38_boolean_in_span", "(trash OR clown) NEAR/30 (moron OR scum)", f"{TOK} SELECT DISTINCT x.doc_id FROM tok x JOIN tok y USING (doc_id) WHERE x.t IN ('trash', 'clown') AND y.t IN ('moron', 'scum') AND abs(x.p - y.p) <= 31")


@_query(_having(f"{_has('trash')} OR {_has('moron')}"))
def q42_any(spark, sf_dir):
    return S.match_any(index_of(spark, sf_dir), ["trash", None, "moron"])


@_query("SELECT doc_id, lower(text) LIKE '%idiot%' AND regexp_matches(lower(text), '(^|[^a-z0-9_])idiot($|[^a-z0-9_])') AS matched FROM documents")
def q_sequential(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.matches_column(F.col("text"), "idiot").alias("matched"))


@_query("WITH q AS (SELECT * FROM (VALUES ('en', 'trash'), ('de', 'und'), ('es', 'que')) v(lang, word)) SELECT doc_id FROM documents JOIN q USING (lang) WHERE regexp_matches(strip_accents(lower(text)), '(^|[^a-z0-9_ß])' || word || '($|[^a-z0-9_ß])')")
def q43_correlated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.join(F.broadcast(spark.createDataFrame([("en", "trash"), ("de", "und"), ("es", "que")], "lang string, query string")), "lang")
    return rows.where(S.correlated(rows, "text", "query")).select("doc_id")


@_query(_having(f"{_has('trash')} AND {_has('idiot')}"))
def q_several_clauses(spark, sf_dir):
    return S.match(index_of(spark, sf_dir), "trash", "idiot")


# Analysis
@_query(f"{TOK} SELECT doc_id, p AS pos, t AS token FROM tok")
def q_tokenize(spark, sf_dir):
    rows = S.tokenize(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


@_query("SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents")
def q_tokenize_whitespace(spark, sf_dir):
    from spanlake.functions.analysis import AnalyzerSpec

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(token_column(F.col("text"), AnalyzerSpec(tokenizer="whitespace"))).cast("long").alias("n"))


# Index tables and statistics
@_query(f"{TOK} SELECT t AS term, count(DISTINCT doc_id) AS df FROM tok GROUP BY t")
def q_dictionary(spark, sf_dir):
    return index_of(spark, sf_dir).terms.select("term", "df")


@_query(f"{TOK} SELECT t AS term, doc_id, count(*) AS tf, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM tok GROUP BY t, doc_id")
def q_postings(spark, sf_dir):
    return index_of(spark, sf_dir).postings.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


@_query(f"{TOK} SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS max_length, (SELECT count(DISTINCT t) FROM tok) AS n_terms FROM dl")
def q_index_stats(spark, sf_dir):
    return index_of(spark, sf_dir).index_stats().select("n_docs", "n_tokens", F.col("max_length").cast("long").alias("max_length"), "n_terms")


@_query("SELECT 'none' AS severity, 'none' AS location, 'none' AS message WHERE false")
def q_verify(spark, sf_dir):
    return index_of(spark, sf_dir).verify(table(spark, sf_dir, "documents"))


@_query(f"{TOK} SELECT count(DISTINCT doc_id) AS n FROM tok WHERE t = 'the'")
def q_count(spark, sf_dir):
    return spark.range(1).select(F.lit(S.count(index_of(spark, sf_dir), "the")).cast("long").alias("n"))


# Scores
@_query(_bm25([("clown", 1), ("idiot", 1), ("trash", 1)], _any("clown", "idiot", "trash")) + " SELECT doc_id, score FROM sc")
def q_full_score(spark, sf_dir):
    return S.full_scores(index_of(spark, sf_dir), "trash OR idiot OR clown")


@_query(_bm25([("clown", 1), ("trash", 2.5)], _any("clown", "trash")) + " SELECT doc_id, score FROM sc")
def q36_boost(spark, sf_dir):
    return S.full_scores(index_of(spark, sf_dir), "trash^2.5 OR clown")


@_query(_bm25([("trash", 1)], _any("the", "trash")) + " SELECT doc_id, score FROM sc")
def q_score_elided(spark, sf_dir):
    """`the` is in more than a tenth of all documents, so it matches but doesn't score."""
    return S.scores(index_of(spark, sf_dir), "trash OR the")


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 10")
def q_top_k(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), "idiot OR clown", limit=10, snippet="none").drop("snippet")


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT doc_id, score FROM sc ORDER BY score DESC, doc_id LIMIT 5 OFFSET 3")
def q_offset(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), "idiot OR clown", limit=5, offset=3, snippet="none").drop("snippet")


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT sc.doc_id, score FROM sc JOIN documents d USING (doc_id) WHERE source = 'src3' ORDER BY score DESC, doc_id LIMIT 4")
def q_residual_filter(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), "idiot OR clown", limit=4, snippet="none", source=table(spark, sf_dir, "documents"), where="source = 'src3'").drop("snippet")


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT doc_id, score, (SELECT max(score) FROM sc) AS max_score FROM sc")
def q_max_score(spark, sf_dir):
    return S.with_max_score(S.full_scores(index_of(spark, sf_dir), "idiot OR clown"))


@_query("SELECT * FROM (VALUES ('clown', CAST(2 AS FLOAT)), ('trash', CAST(1 AS FLOAT))) v(term, weight)")
def q_score_inspect(spark, sf_dir):
    from spanlake.operators.score import inspect

    return inspect(index_of(spark, sf_dir), "trash OR clown^2 OR the")


# Highlights
@_query(f"{TOK} SELECT doc_id, regexp_replace(text, '\\b(trash|clown)\\b', '<b>\\1</b>', 'gi') AS snippet FROM documents WHERE doc_id IN ({_any('trash', 'clown')})")
def q_highlight(spark, sf_dir):
    index, docs = index_of(spark, sf_dir), table(spark, sf_dir, "documents")
    hit = S.match(index, "trash OR clown")
    return docs.join(hit, "doc_id", "left_semi").select("doc_id", S.highlight_column(F.col("text"), "trash OR clown").alias("snippet"))


# Composition with the other tables
_HIT = "(SELECT DISTINCT doc_id FROM tok WHERE t IN ('idiot', 'clown'))"


def _hits(spark, sf_dir) -> DataFrame:
    return S.match(index_of(spark, sf_dir), "idiot OR clown")


@_query(f"{TOK} SELECT h.doc_id, quality, toxic FROM {_HIT} h JOIN labels l USING (doc_id)")
def h_inner_join(spark, sf_dir):
    return _hits(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


@_query(f"{TOK} SELECT h.doc_id, coalesce(toxic, -1) AS toxic FROM {_HIT} h LEFT JOIN labels l USING (doc_id)")
def h_left_join(spark, sf_dir):
    return _hits(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@_query(f"{TOK} SELECT coalesce(h.doc_id, l.doc_id) AS doc_id, h.doc_id IS NOT NULL AS hit, l.doc_id IS NOT NULL AS labelled FROM {_HIT} h FULL JOIN labels l ON h.doc_id = l.doc_id")
def h_full_join(spark, sf_dir):
    a = _hits(spark, sf_dir).withColumn("hit", F.lit(True))
    b = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("labelled"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@_query(f"{TOK} SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN {_HIT}")
def h_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(_hits(spark, sf_dir), "doc_id", "left_semi")


@_query(f"{TOK} SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN {_HIT}")
def h_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(_hits(spark, sf_dir), "doc_id", "left_anti")


@_query(f"{TOK} SELECT c_custkey, c_name, count(*) AS n_orders FROM {_HIT} h JOIN customer ON c_custkey = h.doc_id JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def h_join_orders(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    hit = _hits(spark, sf_dir).join(c, F.col("doc_id") == c.c_custkey)
    return hit.join(o, c.c_custkey == o.o_custkey).groupBy("c_custkey", "c_name").agg(F.count("*").alias("n_orders"))


@_query(f"{TOK} SELECT a.doc_id, b.conv_id FROM {_HIT} a JOIN (SELECT DISTINCT conv_id FROM conversations WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])')) b ON a.doc_id = b.conv_id")
def h_both_sides_searched(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    right = S.match(_conversations(spark, sf_dir), "the").withColumnRenamed("doc_id", "key").join(conv, "key").select("conv_id").distinct()
    left = _hits(spark, sf_dir)
    return left.join(right, left.doc_id == right.conv_id)


def _conversations(spark, sf_dir) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, "conversations")
    if key not in _built:
        _built[key] = Index.build(table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn")), "text", "key")
    return _built[key]


@_query(f"{TOK} SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents WHERE doc_id IN {_HIT} GROUP BY lang")
def h_group_by(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


def _found(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(_hits(spark, sf_dir), "doc_id", "left_semi")


@_query(f"{TOK} SELECT lang, source, count(*) AS n FROM documents WHERE doc_id IN {_HIT} GROUP BY ROLLUP (lang, source)")
def h_rollup(spark, sf_dir):
    return _found(spark, sf_dir).rollup("lang", "source").agg(F.count("*").alias("n"))


@_query(f"{TOK} SELECT lang, source, count(*) AS n FROM documents WHERE doc_id IN {_HIT} GROUP BY CUBE (lang, source)")
def h_cube(spark, sf_dir):
    return _found(spark, sf_dir).cube("lang", "source").agg(F.count("*").alias("n"))


@_query(f"{TOK} SELECT count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents WHERE doc_id IN {_HIT}")
def h_count_distinct(spark, sf_dir):
    return _found(spark, sf_dir).agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"))


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT doc_id, source, rank() OVER (PARTITION BY source ORDER BY score DESC) AS rank FROM sc JOIN documents USING (doc_id)")
def h_window_rank(spark, sf_dir):
    scored = S.full_scores(index_of(spark, sf_dir), "idiot OR clown").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return scored.select("doc_id", "source", F.rank().over(Window.partitionBy("source").orderBy(F.desc("score"))).cast("long").alias("rank"))


@_query(f"{TOK} SELECT doc_id FROM tok WHERE t = 'idiot' UNION SELECT doc_id FROM tok WHERE t = 'clown'")
def h_union(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return S.match(index, "idiot").union(S.match(index, "clown")).distinct()


@_query(f"{TOK} SELECT doc_id FROM tok WHERE t = 'idiot' INTERSECT SELECT doc_id FROM tok WHERE t = 'clown'")
def h_intersect(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return S.match(index, "idiot").intersect(S.match(index, "clown"))


@_query(f"{TOK} SELECT doc_id FROM tok WHERE t = 'idiot' EXCEPT SELECT doc_id FROM tok WHERE t = 'clown'")
def h_except(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return S.match(index, "idiot").exceptAll(S.match(index, "clown"))


@_query(f"{TOK} SELECT doc_id FROM documents WHERE doc_id IN {_HIT} OR doc_id < 20")
def h_match_or_column(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hit = _hits(spark, sf_dir).withColumn("hit", F.lit(True))
    return docs.join(hit, "doc_id", "left").where("hit OR doc_id < 20").select("doc_id")


@_query(_bm25([("idiot", 1)], _any("idiot"), extra="""
, r1 AS (SELECT 'idiot' AS query, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc)""") + " SELECT k AS key, doc_id, score, rank FROM r1, (VALUES (1), (2)) v(k) WHERE rank <= 3")
def h_top_k_per_row(spark, sf_dir):
    outer = spark.createDataFrame([(1, "idiot"), (2, "idiot")], "key int, query string")
    return S.top_k_per(outer, index_of(spark, sf_dir), "query", 3, ["key"]).select("key", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# Several fields
def _fielded(spark, sf_dir) -> Index:
    key = (spark.sparkContext.applicationId, sf_dir, "fielded")
    if key not in _built:
        _built[key] = Index.build(table(spark, sf_dir, "documents").withColumn("label", F.concat_ws(" ", "lang", "source")), ["label", "text"], weights={"label": 2.0})
    return _built[key]


@_query(f"{TOK} SELECT doc_id FROM documents WHERE source = 'src3' AND doc_id IN (SELECT doc_id FROM tok WHERE t = 'the')")
def q37_field_scope(spark, sf_dir):
    return S.match(_fielded(spark, sf_dir), "label:(src3) AND text:(the)")


@_query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'")
def q37_phrase_in_one_field(spark, sf_dir):
    return S.match(_fielded(spark, sf_dir), '"en src3"')


#: The words of both fields of `_fielded`, 0 the label and 1 the text, and weighted BM25 over them.
_BM25F = f"""{TOK},
ft AS (SELECT doc_id, 1 AS f, t FROM tok UNION ALL SELECT doc_id, 0 AS f, unnest([lower(lang), lower(source)]) AS t FROM documents),
fl AS (SELECT doc_id, count(*) FILTER (f = 0) AS n0, count(*) FILTER (f = 1) AS n1 FROM ft GROUP BY doc_id),
w AS (SELECT unnest(['src3', 'trash']) AS t),
st AS (SELECT count(*) AS n, CAST(CAST(CAST(CAST(2 AS FLOAT) * CAST(sum(n0) AS FLOAT) AS FLOAT) + CAST(sum(n1) AS FLOAT) AS FLOAT) / CAST(count(*) AS FLOAT) AS FLOAT) AS avgdl FROM fl),
df AS (SELECT t, count(DISTINCT doc_id) AS df FROM ft JOIN w USING (t) GROUP BY t),
m AS (SELECT t, CAST(greatest(0, ln(1 + (st.n - df + 0.5) / (df + 0.5))) AS FLOAT) AS mult FROM df, st),
c AS (SELECT doc_id, t, f, count(*) AS n FROM ft JOIN w USING (t) GROUP BY doc_id, t, f),
r AS (SELECT doc_id, t, f, CAST(list_max(list_filter([1, 2, 3, 5, 10, 20, 41, 85, 177, 371, 777, 1626, 3405, 7132, 14938, 31288], lambda x: x <= n)) AS FLOAT) AS rep FROM c),
tf AS (SELECT doc_id, t, CAST(coalesce(sum(CAST(2 AS FLOAT) * rep) FILTER (f = 0), 0) + coalesce(sum(rep) FILTER (f = 1), 0) AS FLOAT) AS tf FROM r GROUP BY doc_id, t),
k AS (SELECT CAST(1.2 AS FLOAT) AS k1, CAST(0.75 AS FLOAT) AS b),
pt AS (SELECT doc_id, t, CAST(CAST(CAST(mult * tf AS FLOAT) * CAST(k1 + CAST(1 AS FLOAT) AS FLOAT) AS FLOAT)
  / CAST(CAST(tf + CAST(k1 * CAST(CAST(1 AS FLOAT) - b AS FLOAT) AS FLOAT) AS FLOAT)
  + CAST(CAST(CAST(k1 * b AS FLOAT) / avgdl AS FLOAT) * CAST(CAST(CAST(2 AS FLOAT) * CAST(n0 AS FLOAT) AS FLOAT) + CAST(n1 AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT) AS FLOAT) AS s
  FROM tf JOIN m USING (t) JOIN fl USING (doc_id), st, k)
SELECT doc_id, list_reduce(list(s ORDER BY t), lambda a, b: CAST(a + b AS FLOAT)) AS score FROM pt GROUP BY doc_id"""


@_query(_BM25F)
def q_weighted_fields(spark, sf_dir):
    """Weighted multi-field BM25."""
    return S.full_scores(_fielded(spark, sf_dir), "src3 OR trash")


_BOTH = "SELECT doc_id FROM tok WHERE t = 'idiot' INTERSECT SELECT doc_id FROM tok WHERE t = 'the'"


@_query(_bm25([("idiot", 1), ("the", 1)], _BOTH) + " SELECT a.doc_id, CAST(a.s + b.s AS FLOAT) AS score FROM pt a JOIN pt b USING (doc_id) WHERE a.t = 'idiot' AND b.t = 'the'")
def q_multi_column_sum(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return S.multi_column_scores([(index, "idiot"), (index, "the")])


# Incremental maintenance
@_query(f"{TOK} SELECT DISTINCT doc_id FROM tok WHERE t = 'the' AND doc_id % 10 <> 3")
def q_delete_then_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = Index.build(docs.where("doc_id % 2 = 0"), "text").append(docs.where("doc_id % 2 = 1"))
    return S.match(index.delete(docs.where("doc_id % 10 = 3").select("doc_id")), "the")


@_query(f"{TOK} SELECT t AS term, count(DISTINCT doc_id) AS df FROM tok WHERE doc_id % 10 <> 3 GROUP BY t")
def q_compact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = Index.build(docs.where("doc_id % 2 = 0"), "text").append(docs.where("doc_id % 2 = 1"))
    return index.delete(docs.where("doc_id % 10 = 3").select("doc_id")).compact().terms.select("term", "df")


@_query(f"{TOK} SELECT DISTINCT doc_id FROM tok WHERE t = 'idiot'")
def q_streaming(spark, sf_dir):
    """The index grows by micro-batches of a stream of Parquet files."""
    import uuid

    from spanlake.sources.scratch import shared_dir
    from spanlake.streaming.maintain import maintain

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs.repartition(3).write.parquet(f"{at}/in")
    index = Index.build(docs.limit(0), "text", path=f"{at}/index")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    maintain(stream, index.path, f"{at}/log", fan=3).awaitTermination()
    return S.match(Index.open(spark, index.path), "idiot")


# Constants
@_query("""SELECT unnest(string_split('a an the and or but if then else as at by for from in into of on to with is am are was were be been being it its this that these those
i you he she we they me him her us them my your our their not no do does did have has had can will', ' ')) AS word""".replace("\n", " "))
def q_stop_words(spark, sf_dir):
    return S.stop_word_table(spark, "en")


@_query("SELECT * FROM (VALUES ('beer', 'beer'), ('a b', '\"a b\"'), ('AND', '\"AND\"')) v(word, quoted)")
def q_maybe_quote(spark, sf_dir):
    S.register(spark)
    return spark.sql("SELECT word, ql_maybe_quote(word) AS quoted FROM VALUES ('beer'), ('a b'), ('AND') t(word)")


# ------------------------------------------------------------------ the language's remaining forms
_match("q13_phrase_escapes", '"of t\\he"', SQL["q09_phrase"])
_match("q39_precedence", "trash OR clown AND idiot", _having(f"{_has('trash')} OR {_has('clown')} AND {_has('idiot')}"))
_match("q40_keywords_in_lower_case", "and trash", _having(f"{_has('and')} AND {_has('trash')}"))
_match("q32_empty_operand", '("!!" IN FIRST 3 WORDS) OR trash', _having(_has("trash")))
_match("q23_empty_operand", "* AND NOT ((!!) WITHIN 3)", f"{TOK} SELECT doc_id FROM dl")


@_query(_having(f"{_has('trash')} OR {_has('clown')}"))
def q41_implicit_or(spark, sf_dir):
    return S.match(index_of(spark, sf_dir), "trash clown", implicit="or")


@_query(f"{TOK} SELECT x.doc_id, CAST(count(*) AS INT) AS freq FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.t = 'of' AND y.t = 'the' AND y.p = x.p + 1 GROUP BY x.doc_id")
def q_span_freq(spark, sf_dir):
    return S.span_freq(index_of(spark, sf_dir), '"of the"')


# Scoring terms
@_query(_bm25([("moron", 1), ("trash", 1)], _any("trash")) + " SELECT doc_id, score FROM sc")
def q_term_add(spark, sf_dir):
    return S.scores(index_of(spark, sf_dir), "trash", term_add=["moron"])


@_query(_bm25([("clown", 1)], _any("trash")) + " SELECT doc_id, score FROM sc")
def q_term_replace(spark, sf_dir):
    return S.scores(index_of(spark, sf_dir), "trash", term_replace=["clown"])


@_query(_bm25([("trash", 1)], _any("trash", "clown")) + " SELECT doc_id, score FROM sc")
def q_score_stop_words(spark, sf_dir):
    return S.scores(index_of(spark, sf_dir), "trash OR clown", score_stop_words="clown")


@_query(_bm25([("clown", 1), ("trash", 2)], _any("clown", "trash")) + " SELECT doc_id, score FROM sc")
def q_scoring_repeats(spark, sf_dir):
    return S.full_scores(index_of(spark, sf_dir), "trash OR trash OR clown")


@_query(_bm25("SELECT DISTINCT t, CAST(1 AS FLOAT) FROM tok WHERE t LIKE 'worth%'", "SELECT DISTINCT doc_id FROM tok WHERE t LIKE 'worth%'") + " SELECT doc_id, score FROM sc")
def q_score_expansion(spark, sf_dir):
    return S.full_scores(index_of(spark, sf_dir), "worth*")


@_query(_bm25([("idiot", 1), ("the", 1)], _BOTH) + " SELECT doc_id, score FROM sc")
def q_clause_scores(spark, sf_dir):
    return S.clause_scores(index_of(spark, sf_dir), "idiot", "the")


@_query(_bm25([("clown", 1), ("idiot", 1), ("trash", 1)], _any("clown", "idiot", "trash")) + """
SELECT k.key, r.doc_id, r.s AS score, r.rank FROM (SELECT t, doc_id, s, row_number() OVER (PARTITION BY t ORDER BY s DESC, doc_id) AS rank FROM pt) r
JOIN (VALUES (1, 'idiot'), (2, 'clown'), (3, 'trash')) k(key, t) USING (t) WHERE r.rank <= 3""")
def h_top_k_of_several_queries(spark, sf_dir):
    outer = spark.createDataFrame([(1, "idiot"), (2, "clown"), (3, "trash"), (4, None)], "key int, query string")
    return S.top_k_per(outer, index_of(spark, sf_dir), "query", 3, ["key"], block=2).select("key", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


# Snippets and marks
def _marked(words: str) -> str:
    return f"regexp_replace(text, '\\b({words})\\b', '<b>\\1</b>', 'gi')"


@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + f" SELECT s.doc_id, score, {_marked('idiot|clown')} AS snippet FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 5) s JOIN documents USING (doc_id)")
def q_snippet(spark, sf_dir):
    return S.search(index_of(spark, sf_dir), "idiot OR clown", limit=5, source=table(spark, sf_dir, "documents"))


@_query(f"{TOK} SELECT doc_id, {_marked('idiot|trash')} AS snippet FROM documents WHERE doc_id IN ({_any('trash')}) AND doc_id IN ({_any('idiot')})")
def q_highlight_bound(spark, sf_dir):
    """Marks of the clauses of the search itself."""
    return S.hits(index_of(spark, sf_dir), table(spark, sf_dir, "documents"), "trash", "idiot").select("doc_id", "snippet")


@_query(f"{TOK} SELECT doc_id, lang || ' <b>src3</b>' AS snippet FROM documents WHERE source = 'src3' AND doc_id IN ({_any('the')})")
def q_highlight_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("label", F.concat_ws(" ", "lang", "source"))
    return S.hits(_fielded(spark, sf_dir), docs, "label:(src3) AND text:(the)", field="label").select("doc_id", "snippet")


@_query(f"{TOK} SELECT doc_id, regexp_replace(text, '\\b(clown)\\b', chr(27) || '[1;35m\\1' || chr(27) || '[0m', 'gi') AS marked FROM documents WHERE doc_id IN ({_any('clown')})")
def q_highlight_ansi(spark, sf_dir):
    index, docs = index_of(spark, sf_dir), table(spark, sf_dir, "documents")
    return docs.join(S.match(index, "clown"), "doc_id", "left_semi").select("doc_id", S.highlight_ansi_column(F.col("text"), "clown").alias("marked"))


# Records, generations, faults
@_query(f"{TOK} SELECT doc_id, t AS term, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions FROM tok GROUP BY doc_id, t")
def q_forward(spark, sf_dir):
    rows = index_of(spark, sf_dir).forward(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.explode("words").alias("term", "p")).select("doc_id", "term", F.array_join("p", ",").alias("positions"))


def _halves(spark, sf_dir) -> Index:
    docs = table(spark, sf_dir, "documents")
    return Index.build(docs.where("lang = 'en'"), "text").append(docs.where("lang <> 'en'"))


@_query(f"""{TOK}, g AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS gen FROM documents),
pf AS (SELECT gen, t, doc_id, count(*) AS tf FROM tok JOIN g USING (doc_id) GROUP BY gen, t, doc_id)
SELECT gen, count(DISTINCT doc_id) AS n_docs, 0 AS n_dead, count(DISTINCT t) AS n_terms, count(*) AS n_postings, CAST(sum(tf) AS BIGINT) AS n_tokens,
  CAST(min(n) AS INT) AS min_length, CAST(max(n) AS INT) AS max_length, CAST(max(tf) AS INT) AS max_tf FROM pf JOIN dl USING (doc_id) GROUP BY gen""")
def q_segment_info(spark, sf_dir):
    return _halves(spark, sf_dir).segment_info()


@_query(f"{TOK} SELECT t AS term, count(DISTINCT doc_id) AS df, 2 AS generations FROM tok GROUP BY t")
def q_tiered_merge(spark, sf_dir):
    """Four small generations become one beside a large one."""
    docs = table(spark, sf_dir, "documents")
    index = Index.build(docs.where("lang = 'en'"), "text")
    for k in range(4):
        index = index.append(docs.where((F.col("lang") != "en") & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k)))
    index = index.merge(4)
    return index.terms.select("term", "df", F.lit(len(index.meta["gens"])).alias("generations"))


@_query(f"{TOK} SELECT 'warning' AS severity, 'doc ' || doc_id AS location, 'row has gone or changed' AS message FROM dl JOIN documents USING (doc_id) WHERE source = 'src3'")
def q_verify_faults(spark, sf_dir):
    """Rows that have changed behind the index's back."""
    docs = table(spark, sf_dir, "documents")
    changed = docs.withColumn("text", F.when(F.col("source") == "src3", F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    return index_of(spark, sf_dir).verify(changed)


@_query("""SELECT * FROM (VALUES ('accent_folding', false), ('analysis_version', false), ('case_folding', false), ('dictionary', false), ('graphemes', false), ('long_tokens', false),
('max_token_bytes', false), ('position_gaps', false), ('tokenizer', true)) v(option, drifted)""")
def q_index_analysis(spark, sf_dir):
    from spanlake.functions.analysis import AnalyzerSpec

    return index_of(spark, sf_dir).index_analysis(AnalyzerSpec(tokenizer="whitespace")).select("option", "drifted")


# Analysis
@_query("SELECT doc_id, len(x) AS n, coalesce(list_sum(list_transform(x, lambda w: strlen(w))), 0) AS bytes FROM (SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS x FROM documents)")
def q_token_spans(spark, sf_dir):
    """Places of tokens in the text, in bytes."""
    from spanlake.functions.analysis import AnalyzerSpec, token_spans

    rows = table(spark, sf_dir, "documents").select("doc_id", token_spans(F.col("text"), AnalyzerSpec(tokenizer="whitespace", max_token_bytes=2692)).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0).cast("long"), lambda s, t: s + t["end"] - t["start"]).alias("bytes"))


@_query("SELECT * FROM (VALUES (0, '我'), (1, '爱'), (2, '北京'), (3, '天安门'), (4, 'ok'), (5, '天'), (6, '京')) v(pos, token)")
def q_dictionary_tokenizer(spark, sf_dir):
    from spanlake.functions.analysis import AnalyzerSpec

    spec = AnalyzerSpec(tokenizer="dictionary").with_words({"北京": 30, "天安门": 10, "安门": 1, "我": 20, "爱": 20})
    return S.tokenize(spark.createDataFrame([("我爱北京天安门, OK 天京",)], "text string"), "text", spec).select("pos", "token")


@_query(f"""{TOK}, tk AS (SELECT doc_id, t, p FROM tok) SELECT CASE WHEN strlen(w) > 8 THEN 'long' ELSE 'whole' END AS kind, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\s]+')) AS w FROM documents) GROUP BY ALL""")
def q_long_tokens(spark, sf_dir):
    """Tokens of whitespace text that a limit of 8 bytes cuts, and those it leaves."""
    from spanlake.functions.analysis import AnalyzerSpec

    docs, at = table(spark, sf_dir, "documents").select("doc_id", "text"), {}
    for policy in ("truncate", "discard"):
        spec = AnalyzerSpec(tokenizer="whitespace", case_folding="preserve", accent_folding="preserve", long_tokens=policy, max_token_bytes=8)
        at[policy] = S.tokenize(docs, "text", spec).agg(F.count("*").alias(policy))
    both = at["truncate"].join(at["discard"])  # two rows of totals
    return both.select(F.explode(F.array(F.struct(F.lit("long").alias("kind"), (F.col("truncate") - F.col("discard")).alias("n")), F.struct(F.lit("whole").alias("kind"), F.col("discard").alias("n")))).alias("x")).select("x.*")


@_query("SELECT event_id AS doc_id FROM events WHERE json_extract_string(props, '$.k') = '69'")
def q_json_index(spark, sf_dir):
    """An index over an expression: a member of a JSON text."""
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return S.match(Index.build(events, "k", "event_id"), "69")


# Composition
@_query(f"{TOK} SELECT lang, source, count(*) AS n FROM documents WHERE doc_id IN {_HIT} GROUP BY GROUPING SETS ((lang), (source), ())")
def h_grouping_sets(spark, sf_dir):
    found = _found(spark, sf_dir)
    return found.groupingSets([[F.col("lang")], [F.col("source")], []], F.col("lang"), F.col("source")).agg(F.count("*").alias("n")).select("lang", "source", "n")


@_query(f"{TOK} SELECT h.doc_id, n_nationkey FROM {_HIT} h JOIN nation ON h.doc_id < n_nationkey * 10 AND n_regionkey >= 2")
def h_theta_join(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey >= 2")
    return _hits(spark, sf_dir).join(nation, F.col("doc_id") < F.col("n_nationkey") * 10).select("doc_id", "n_nationkey")


# SQL text
@_query(_bm25([("clown", 1), ("idiot", 1)], _any("clown", "idiot")) + " SELECT s.doc_id, score, source FROM (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 10) s JOIN documents USING (doc_id)")
def q_sql_search(spark, sf_dir):
    from spanlake.sql import name_index, sql

    name_index("articles", index_of(spark, sf_dir))
    table(spark, sf_dir, "documents").createOrReplaceTempView("article_rows")
    return sql(spark, "SELECT s.doc_id, s.score, d.source FROM search('articles', 'idiot OR clown', 10, snippet => 'none') s JOIN article_rows d ON d.doc_id = s.doc_id")


@_query("SELECT * FROM (VALUES ('wi', 0, 0, 2), ('fi', 1, 3, 5), ('3.14', 2, 6, 10), ('can''t', 3, 11, 16)) v(token, pos, from_byte, to_byte)")
def q_sql_tokenize(spark, sf_dir):
    from spanlake.sql import sql

    return sql(spark, "SELECT token, pos, start AS from_byte, end AS to_byte FROM tokenize('Wi-Fi 3.14 can''t')")


@_query(f"{TOK} SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM dl")
def q_sql_index_stats(spark, sf_dir):
    from spanlake.sql import name_index, sql

    name_index("articles", index_of(spark, sf_dir), table(spark, sf_dir, "documents"))
    return sql(spark, "SELECT n_docs, n_tokens FROM index_stats('articles') WHERE NOT EXISTS (SELECT 1 FROM verify_index('articles'))")
