"""The index, compiled plans and scores."""

import random
import struct

import pytest

from spanlake import search as S
from spanlake.functions.analysis import Analyzer
from spanlake.operators.evaluate import Doc, evaluate
from spanlake.operators.highlight import highlight, highlight_ansi
from spanlake.plans.parser import QueryError
from spanlake.plans.query import compile_query
from spanlake.sources.index import Index
from tests.test_language import DRINKS


def bits(x):
    return struct.pack(">f", x).hex()


def build(spark, texts, **k):
    return Index.build(spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, body string"), "body", buckets=2, spread=1, **k)


def found(index, q):
    return sorted(r[0] for r in S.match(index, q).collect())


@pytest.fixture(scope="module")
def drinks(spark):
    return build(spark, DRINKS)


def test_scores_bit_for_bit(spark, drinks):
    assert {r.doc_id: bits(r.score) for r in S.full_scores(drinks, "beer").collect()} == {1: "3f27a5e8", 3: "3f3c75a5", 4: "3f16f9d3", 7: "3f8fd30c"}
    assert [r.doc_id for r in S.search(drinks, "wine OR stout^5", snippet="none").collect()] == [4, 2, 1, 6]


def fielded(spark, rows, **k):
    return Index.build(spark.createDataFrame(rows, "doc_id long, title string, body string"), ["title", "body"], buckets=2, spread=1, **k)


@pytest.mark.parametrize("rows, weights, query, want", [
    ([(1, "needle", "pad"), (2, "pad", "needle"), (3, "needle needle", "pad")], None, "needle", {3: "3e2e071f", 1: "3e113925", 2: "3e113925"}),
    ([(1, "needle", "pad"), (2, "pad", "needle needle needle")], {"title": 3.0, "body": 1.0}, "needle", {1: "3e99424c", 2: "3e8ca98f"}),
    ([(1, "needle", "pad"), (2, "pad", "needle"), (3, "needle", "needle")], None, "needle", {3: "3e3c031f", 1: "3e08bc74", 2: "3e08bc74"}),
    ([(1, "needle", "x"), (2, "needle", "x " * 30)], None, "needle", {1: "3e91be8d", 2: "3e0953d6"}),
    ([(1, "needle", "x"), (2, "needle", "x " * 30)], None, "title:(needle)", {1: "3e91be8d", 2: "3e0953d6"}),
])
def test_weighted_fields_bit_for_bit(spark, rows, weights, query, want):
    ranked = S.search(fielded(spark, rows, weights=weights), query, snippet="none").collect()
    assert {r.doc_id: bits(r.score) for r in ranked} == want and [r.doc_id for r in ranked] == list(want)


def test_single_column_bit_for_bit(spark):
    ix = build(spark, ["needle", "needle needle", "pad"])
    assert [(r.doc_id, bits(r.score)) for r in S.search(ix, "needle", snippet="none").collect()] == [(2, "3f110b5e"), (1, "3f060744")]


def test_several_fields(spark):
    ix = fielded(spark, [(1, "alpha beta", "other"), (2, "alpha", "beta"), (3, "beta alpha", "pad"), (4, "alpha xx beta", "pad"), (5, None, "needle here"), (6, "needle", None), (7, "pad", "alpha beta")])
    assert found(ix, '"alpha beta"') == [1, 7] and found(ix, 'title:("alpha beta")') == [1] and found(ix, "alpha THEN/0 beta") == [1, 7] and found(ix, "* AND NOT title:(*)") == [5]
    with pytest.raises(QueryError):
        S.match(ix, "nope:(x)")
    both = S.clause_scores(ix, "alpha", "beta")
    assert {r.doc_id: bits(r.score) for r in both.collect()} == {r.doc_id: bits(r.score) for r in S.full_scores(ix, "alpha AND beta").collect()}


def test_highlighting():
    assert highlight("Fuji, apple!", query='"fuji apple"') == "<b>Fuji, apple</b>!" and highlight("b a b", query="a BEFORE b") == "b <b>a</b> <b>b</b>"
    assert highlight("send email now", '<b title="$QUERY_PART">', "</b>", "email*") == 'send <b title="MATCHES email.*">email</b> now'
    assert highlight("a b c", query="(a NEAR/3 c) ENCLOSES b") == "<b>a b c</b>" and highlight("x", query="(") == "x" and highlight(None, query="x") is None
    assert highlight_ansi("red apple", query="red") == "\x1b[1;31mred\x1b[0m apple" and highlight_ansi("red apple", query="apple") == "red \x1b[1;34mapple\x1b[0m"
    assert highlight_ansi("fuji apple", query='"fuji apple"') == "\x1b[97;104mfuji apple\x1b[0m"
    assert highlight_ansi("one two three four five apple", 10, "apple") == "one two\nthree four\nfive \x1b[1;34mapple\x1b[0m"
    with pytest.raises(QueryError):
        highlight_ansi("x", 0, "x")


@pytest.mark.parametrize("prune", [False, True])
def test_compiled_plans_equal_the_evaluator(spark, prune, monkeypatch):
    from spanlake.operators import compile as C

    if prune:  # by the rarest word that a match must have
        monkeypatch.setattr(C, "PRUNE_ABOVE", 0)
    r, words, a = random.Random(3), ["a", "b", "c", "d", "ab", "abc"], Analyzer()
    texts = [" ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(60)] + [None, "...", "a"]
    if prune:
        r = random.Random(4)
        texts = [" ".join(r.choices(words, [9, 9, 9, 9, 9, 0.3], k=r.randint(0, 9))) for _ in range(150)] + ["abc a b", "b abc"]
    index = build(spark, texts)

    def any_query(depth):
        if depth == 0:
            return r.choice(words + ["a*", "MATCHES a.?", "ab~1", "a TO b", '"a b"', '"a _ b"', '"b c"~1', "zz", "!!"])
        x, y = any_query(depth - 1), any_query(depth - 1)
        return r.choice([f"({x}) AND ({y})", f"({x}) OR ({y})", f"({x}) AND NOT ({y})", f"[{x.split()[0] if x[0] not in '([' else 'a'} b]", f"AT LEAST 2 OF [({x}) ({y}) a]", f"({x}) THEN/1 ({y})", f"({x}) NEAR/2 ({y})",
                         f"({x}) BEFORE ({y})", f"({x}) ENCLOSES ({y})", f"({x}) NOT OVERLAPPING ({y})", f"({x}) IN FIRST 3 WORDS", f"({x}) IN LAST 50%", f"({x}) WITHIN 3", f"* AND NOT ({x})"])

    done = 0
    while done < 45:
        query = any_query(r.randint(0, 2))
        try:
            q = compile_query(query, a)
        except QueryError:
            continue
        want = [i for i, t in enumerate(texts, 1) if t is not None and evaluate(q, Doc.of({"body": t}, a))]
        assert found(index, query) == want, query
        done += 1


def test_maintenance(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, body string")
    ix = Index.build(df([(1, "red apple"), (2, "green apple")]), "body", buckets=2, spread=1).append(df([(3, "red pear"), (4, None), (5, "")]))
    old = ix
    ix = ix.update(df([(1, "blue plum")])).delete(df([(2, "")]))
    assert found(ix, "red") == [3] and found(ix, "plum") == [1] and found(ix, "apple") == [] and found(old, "apple") == [1, 2]
    assert S.count(ix, "red") == 1 and ix.totals[0] == 4
    small = ix.compact()
    assert small.totals == (2, 4, [4]) and found(small, "*") == [1, 3] and S.count(small, "plum") == 1
    again = Index.open(spark, small.path)
    assert again.verify().count() == 0 and found(again, "plum OR pear") == [1, 3]
    assert again.verify(df([(1, "blue plum"), (3, "red"), (9, "new")])).count() == 2
    assert ix.segment_info().count() == 3 and ix.index_stats().first()["n_dead"] == 2 and not ix.index_analysis().where("drifted").count()


def test_limits_and_elision(spark, drinks):
    assert S.search(drinks, "beer", limit=0).count() == 0 and S.match_any(drinks, []).count() == 0 and S.match(drinks, None).count() == 0
    for bad in (lambda: S.search(drinks, "beer", limit=-1), lambda: S.search(drinks, None), lambda: S.search(drinks, "beer", snippet="x"), lambda: S.full_scores(drinks, "beer", b=2.0)):
        with pytest.raises(QueryError):
            bad()
    hundred = build(spark, ["nine ten eleven"] * 9 + ["ten eleven"] + ["eleven"] + ["pad"] * 89)
    from spanlake.operators.score import inspect
    assert [r.term for r in inspect(hundred, "nine ten eleven").collect()] == ["nine", "ten"]
    assert [r.term for r in inspect(hundred, "eleven^1 nine", score_stop_words="nine").collect()] == ["eleven"]
    assert [r.term for r in inspect(hundred, "nine", term_add=["eleven"]).collect()] == ["eleven", "nine"]
    with pytest.raises(QueryError):
        inspect(hundred, "nine", term_add=["a"], term_replace=["b"])


def test_empty_index(spark):
    ix = build(spark, [None, "", "..."])
    assert found(ix, "*") == [] and S.full_scores(ix, "a").count() == 0 and S.count(ix, "a") == 0


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT ql_matches('red apple', 'apple'), ql_highlight('red apple', '<b>', '</b>', 'apple'), ql_parse('a b'), ql_tokenize('A b'), ql_version()").first()
    assert tuple(row) == (True, "red <b>apple</b>", "AND(a, b)", ["a", "b"], S.VERSION)


def test_spans_whose_words_are_analysed_away(spark, drinks):
    a = drinks.analyzer
    every = [i for i, _ in enumerate(DRINKS, 1)]
    for query, want in (
        ('"!!" IN FIRST 3 WORDS', []), ("(!!) WITHIN 3", []), ("* AND NOT ((!!) IN FIRST 3 WORDS)", every), ('("!!" IN FIRST 3 WORDS) OR beer', [1, 3, 4, 7]),
        ("(beer NOT ENCLOSES (!!)) IN FIRST 1 WORDS", [3, 7]), ("(!! THEN/1 beer) OR wine", [1, 2, 6]), ("[!! beer] NEAR/3 craft", [1]), ("(AT LEAST 2 OF [!! beer craft]) WITHIN 3", [1]), ("beer BEFORE (!!)", []),
    ):
        assert found(drinks, query) == want, query
        q = compile_query(query, a)
        assert [i for i, t in enumerate(DRINKS, 1) if evaluate(q, Doc.of({"body": t}, a))] == want, query


def test_expanding_spans_are_refused():
    words = " ".join(f"w{i}" for i in range(24))
    compile_query(f"(AT LEAST 23 OF [{words}]) WITHIN 3", Analyzer())
    with pytest.raises(QueryError):
        compile_query(f"((AT LEAST 3 OF [{words}]) NEAR/3 a) NEAR/4 (AT LEAST 4 OF [{' '.join(f'(AT LEAST 2 OF [a{i} b{i} c{i} d{i}])' for i in range(18))}])", Analyzer())


def test_merge_by_tiers(spark):
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, body string")
    ix = Index.build(df([(i, f"red w{i}") for i in range(9)]), "body", buckets=2, spread=1)
    for k in range(3):
        ix = ix.append(df([(100 + k, f"red v{k}")]))
    ix = ix.delete(df([(101, "")])).merge(3)
    assert len(ix.meta["gens"]) == 2 and found(ix, "red") == [*range(9), 100, 102] and found(ix, "v1") == [] and ix.verify().count() == 0
    assert ix.merge(3).meta["gens"] == ix.meta["gens"]
    with pytest.raises(Exception, match="exists"):  # two writers from one version
        first = ix.append(df([(200, "x")]))
        ix._save_meta(gens=first.meta["gens"])


def test_settings_and_strict_analysis(spark, drinks):
    spark.conf.set("spanlake.max_expansion_terms", "2")
    try:
        with pytest.raises(QueryError, match="more than 2"):
            S.full_scores(drinks, "b*")
        assert found(drinks, "b*") == [1, 3, 4, 5, 7]
        assert S.full_scores(drinks, "brew*").count() == 2
    finally:
        spark.conf.unset("spanlake.max_expansion_terms")
    old = Index(spark, drinks.path, drinks.meta | {"analysis": 0})
    assert found(old, "beer") == [1, 3, 4, 7] and old.index_analysis().where("drifted").first()["action"] == "rebuild"
    spark.conf.set("spanlake.strict_analysis", "on")
    try:
        with pytest.raises(QueryError, match="rebuild"):
            S.match(old, "beer")
        assert found(drinks, "cider") == [8]
    finally:
        spark.conf.unset("spanlake.strict_analysis")


def test_stream_takes_the_latest_row(spark, tmp_path):
    from spanlake.streaming.maintain import maintain

    rows = spark.createDataFrame([(1, "old", "put", 1), (1, "new", "put", 2), (2, "gone", "put", 1), (2, None, "delete", 2), (3, None, "delete", 1), (3, "back", "put", 2)], "doc_id long, body string, op string, at int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    index = Index.build(rows.select("doc_id", "body").limit(0), "body", path=f"file://{tmp_path}/index", buckets=2, spread=1)
    maintain(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), index.path, f"{tmp_path}/log", op_col="op", order_col="at").awaitTermination()
    index = Index.open(spark, index.path)
    assert found(index, "new OR old") == [1] and found(index, "old") == [] and found(index, "gone") == [] and found(index, "back") == [3]


def test_sql_table_functions(spark, drinks):
    from spanlake.sql import name_index, sql

    source = spark.createDataFrame(list(enumerate(DRINKS, 1)), "doc_id long, body string")
    name_index("drinks", drinks, source)
    got = sql(spark, "SELECT doc_id, snippet, 'search(''x'')' AS kept FROM search('drinks', 'wine OR stout^5', limit => 2) -- search('drinks')\nORDER BY score DESC").collect()
    assert [(r.doc_id, r.snippet, r.kept) for r in got] == [(4, "<b>stout</b> beer from the brewery", "search('x')"), (2, "<b>wine</b> only", "search('x')")]
    assert sql(spark, "SELECT count(*) AS n FROM matches('drinks', 'beer')").first().n == 4
    assert sql(spark, "SELECT * FROM verify_index('drinks')").count() == 0 and sql(spark, "SELECT word FROM builtin_stop_words('en')").count() == 59
    assert [r.term for r in sql(spark, "SELECT term FROM score_inspect('drinks', 'cider^2 OR mead') ORDER BY term").collect()] == ["cider", "mead"]
    for bad in ("SELECT * FROM search('nope', 'x')", "SELECT * FROM search('drinks', 'x', nope => 1)", "SELECT * FROM search('drinks', '(')"):
        with pytest.raises(QueryError):
            sql(spark, bad)


def test_pruned_top_k_equals_the_whole(spark):
    from spanlake.operators import score

    r = random.Random(21)
    texts = [" ".join(["the"] * r.randint(1, 5) + r.choices(["of", "and", "red", "green"], k=r.randint(0, 6)) + ["rare"] * (i % 40 == 0) + ["odd"] * (i % 25 == 0)) for i in range(500)]
    ix = build(spark, texts)
    for query in ("the OR rare", "the OR of OR rare OR odd", "odd^3 OR red OR the", "rare OR odd", "the^0 OR rare", "of OR and OR red OR green", "[the rare zz]"):
        for k in (1, 5, 12, 30):
            want = [(x.doc_id, x.score) for x in S.full_scores(ix, query).orderBy(score.F.desc("score"), "doc_id").limit(k).collect()]
            got = score.top_scores(ix, query, k, above=0)
            assert [(x.doc_id, x.score) for x in got.orderBy(score.F.desc("score"), "doc_id").limit(k).collect()] == want, (query, k)
    assert score.top_scores(ix, "the OR rare", 5, above=0).count() == 13  # documents of the frequent word alone are left out


def test_wide_expansions(spark):
    ix = build(spark, [f"w{i} w{i + 1} x" for i in range(3000)])
    assert S.match(ix, "w*").count() == 3000 and S.match(ix, "w* AND NOT w1").count() == 2998 and S.match(ix, 'w1500 THEN/0 w*').count() == 1
    assert S.full_scores(ix, "w1*").where("score > 0").count() == S.match(ix, "w1*").count() == 1115


def test_files_follow_the_input(spark):
    rows = spark.createDataFrame([(1, "red apple")], "doc_id long, body string")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    joined = docs.join(docs.select("doc_id", "n_chars").withColumnRenamed("n_chars", "n"), "doc_id")
    assert Index.build(rows, "body").meta["buckets"] == 2 and Index.build(joined, "text").meta["buckets"] == 2 and Index.build(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "text").meta["buckets"] == 2


def test_tokens_are_grouped_in_slices(spark):
    """Python holds a slice of a batch, however long its documents are, and postings leave it in packets by file."""
    import pyarrow as pa

    from spanlake.functions.analysis import AnalyzerSpec
    from spanlake.sources import index as I

    words = [[f"w{i % 7}" for i in range(300_000)], ["b", "a", "b"], None, ["w1"] * 250_000, [], *[["x", "y"]] * 50]
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(len(words))), "part": pa.array([i % 2 for i in range(len(words))], pa.int32()),
        "w0": pa.array(words, pa.list_(pa.string())), "t0": pa.array([None, None, "\u6211 z \u6211", *[None] * (len(words) - 3)], pa.string()),
    })
    sizes = [sum(len(w or ()) for w in b.column("w0").to_pylist()) for b in I._slices(batch, 1)]
    assert sum(sizes) == sum(len(w or ()) for w in words) and len(sizes) > 1 and max(sizes) < I.SLICE + 300_000
    packets = list(I._grouped(1, AnalyzerSpec(), 3, 2)([batch]))
    rows = [r for b in I._unpacked(3, 2)(packets) for r in b.to_pylist()]
    posts = {(r["doc_id"], r["term"]): r["positions"] for r in rows if r["field"] == 0}
    assert posts[1, "b"] == [0, 2] and posts[1, "a"] == [1] and posts[2, "\u6211"] == [0, 2] and posts[0, "w3"] == [*range(3, 300_000, 7)] and len(posts) == 7 + 2 + 2 + 1 + 100
    assert all(r["bucket"] == I.bucket_number(r["term"], 3) and r["tf"] == len(r["positions"]) and r["first"] for r in rows if r["field"] == 0)
    assert sorted((r["doc_id"], r["dl"]) for r in rows if r["bucket"] < 0) == [(0, 300_000), (1, 3), (2, 3), (3, 250_000), *((i, 2) for i in range(5, 55))]


def test_documents_are_counted_once_over_fields(spark):
    """Without grouping all postings by document, and after the merge of an index that was written before `first`."""
    rows = [(1, "red", "red wine red"), (2, "red", "beer"), (3, "wine", "wine"), (4, None, "red")]
    ix = Index.build(spark.createDataFrame(rows, "doc_id long, title string, body string"), ["title", "body"])
    want = {"red": 3, "wine": 2, "beer": 1}
    count = lambda index: {r.term: r.df for r in index.terms.collect()}
    assert count(ix) == want and ix._postings(ix.meta["gens"]).where("first").count() == sum(want.values())
    ix = ix.delete(spark.createDataFrame([(2,)], "doc_id long"))
    old = Index(spark, ix.path, {k: v for k, v in ix.meta.items() if k != "firsts"})
    assert count(old.compact()) == {"red": 2, "wine": 2}


def test_verify_reads_rows_and_postings_once(spark):
    """All faults, each as often as it occurs, from one reading of the source and one of the postings by document."""
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, body string")
    ix = Index.build(df([(1, "a b a"), (2, "b"), (3, "c c"), (4, "d")]), "body", buckets=2, spread=1)
    at, row = f"{ix.path}/postings/gen=0", "term string, doc_id long, field int, positions array<int>, tf int, dl int, first boolean"
    put = lambda rows, bucket: spark.createDataFrame(rows, row).write.mode("append").parquet(f"{at}/bucket={bucket}")
    put([("zz", 99, 0, [0], 1, 1, True)], ix.bucket_number("zz"))  # no such document
    put([("q", 2, 0, [5, 3], 2, 1, True)], 1 - ix.bucket_number("q"))  # wrong bucket, positions fall, length 1
    put([("", 3, -1, [2], 2, 2, True), ("", 3, -1, [7], 7, 7, True), ("", None, -1, [1], 1, 1, True)], -1)
    source = df([(1, "a b a"), (2, "b b"), (3, "c c"), (5, "new"), (6, ""), (None, "n")])
    report = ix.verify(source)
    got = sorted((r.severity, r.location, r.message) for r in report.collect())
    assert got == sorted([
        ("error", "doc 99", "postings without a document"),
        ("error", "doc 2", "length differs from its postings"), ("error", "doc 3", "length differs from its postings"), ("error", "doc null", "length differs from its postings"),
        ("error", "doc 3", "repeated or null document id"), ("error", "doc null", "repeated or null document id"),
        ("error", "term q", "positions don't ascend or don't count up to tf"), ("error", "term q", "posting in the wrong bucket"),
        ("error", "doc 5", "row isn't indexed"), ("error", "doc null", "row isn't indexed"),
        ("warning", "doc 2", "row has gone or changed"), ("warning", "doc 3", "row has gone or changed"), ("warning", "doc 4", "row has gone or changed"), ("warning", "doc null", "row has gone or changed"),
    ])
    leaves = report._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = [str(leaves.apply(i).nodeName()) for i in range(leaves.size())]
    assert sum("LogicalRDD" in k or "LocalRelation" in k for k in kinds) == 1 and len(kinds) == 6, kinds
