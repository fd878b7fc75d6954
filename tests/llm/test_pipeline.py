"""The pipeline's stages on the smallest tables, and on odd ones."""

import hashlib

import corpus_pipeline
from spanlake.llm import line_dedup, quality_gam, simhash
from spanlake.llm.byte_bpe import codec
from spanlake.llm.decontaminate import contaminated
from tests.llm.test_operators import ODD, slow_lines

SF = "/root/testdata/sf0.001"


def slow_near(rows):
    """Row numbers of one row of each group of texts linked by fingerprints within 4 bits or five-word Jaccard similarity 0.8."""
    fps = [simhash.fingerprint(t.encode()) for _, t in rows]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if root[a] != root[b] and ((fps[a] ^ fps[b]).bit_count() <= 4 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    return {min((rows[k][0], k) for k in range(len(rows)) if root[k] == g)[1] for g in set(root)}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}

    def step(name, docs):
        out = stages[name](spark, docs, SF).cache()
        rows = sorted((r.doc_id, getattr(r, "text", None)) for r in out.collect())
        kept[name] = len(rows)
        assert name == "bpe_encode" or out.columns == columns
        return out, rows

    docs, rows = step("quality", docs)
    scored = {r.doc_id: r.predicted for r in quality_gam.classify(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert {i for i, _ in rows} == {i for i, p in scored.items() if p}
    cut = slow_lines(rows)
    docs, after = step("line_dedup", docs)
    left = [(i, "\n".join(x for j, x in enumerate(t.split("\n")) if (k, j) not in cut)) for k, (i, t) in enumerate(rows)]
    assert after == [x for k, x in enumerate(left) if x[1].strip() or x[1] == rows[k][1]] and len(cut) > 0
    assert line_dedup.duplicate_lines(docs.select("doc_id", "text")).count() == 0
    docs, rows = step("near_dedup", docs)
    assert rows == [after[k] for k in sorted(slow_near(after))]
    found = {r.doc_id for r in contaminated(docs, bench).collect()}
    docs, rest = step("decontaminate", docs)
    assert rest == [r for r in rows if r[0] not in found] and contaminated(docs, bench).count() == 0
    items = [" ".join(r.text.split()) for r in bench.collect()]
    assert not [i for i, t in rest if any(x in " ".join(t.split()) for x in items)]
    coded, _ = step("bpe_encode", docs)
    c = codec()
    assert {r.doc_id: (list(r.ids), r.ids_sha256) for r in coded.collect()} == {i: (list(memoryview(c.encode(t)).cast("I")), hashlib.sha256(c.encode(t)).hexdigest()) for i, t in rest}
    assert before > kept["quality"] >= kept["line_dedup"] >= kept["near_dedup"] >= kept["decontaminate"] == kept["bpe_encode"] > before / 3
    assert corpus_pipeline.run(spark, SF).count() == kept["bpe_encode"]


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and empty texts, long ones, repeats, shared ids, no rows, further columns, no labels, no benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, cut string, copy string, sig long, kept boolean, h string"
    long = " ".join(f"w{i}" for i in range(60_000))
    given = [*ODD, (20, "x" * 300_000), (21, long), (22, long + " end"), (7, "another text of the same id")]
    rows = [(i, t, "en", "s", len(t or ""), "c", "d", 1, True, "h") for i, t in given]
    for name, data in (("full", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs, sizes = spark.read.parquet(f"{at}/documents.parquet"), []
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, at).cache()
            sizes.append(docs.count())
            if name != "bpe_encode":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")] and docs.where("NOT (cut = 'c' AND copy = 'd' AND sig = 1 AND kept AND h = 'h')").count() == 0
        assert corpus_pipeline.run(spark, at).count() == sizes[-1]
        if not data:
            assert sizes == [0] * 5
            continue
        assert sizes[:2] == [len(rows), len(rows) - 2]  # without labels all stay; the equal line of 8 goes, and 22, like 21
        ids = [r.doc_id for r in docs.collect()]
        assert {4, 5, 6, 7, 20, 21, None} <= set(ids) and ids.count(7) == 3 and not {8, 22} & set(ids) and len({1, 2, 3} & set(ids)) == 1
