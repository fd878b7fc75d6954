"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: 64-bit SimHash over word shingles.  Search: for radius r, every bit
position is given a nonzero code m(i) in F_2^(r+1), all codes equally often, and
table v (one per nonzero v) masks the positions with <m(i), v> = 1.  If two
fingerprints differ in at most r positions, the r equations <m(i), v> = 0 over
those positions have a nonzero solution v, so the pair agrees on the whole mask
of that table: no pair within the radius is missed.

Work is on distinct fingerprints.  A bucket yields a spanning forest of its links,
not its pairs; one above `block` members is bucketed again by finer masks, and what
is still above is dealt out as pairs of blocks of about that size, so no task holds
a bucket whole.  Components come from
alternating large-star and small-star rounds over distributed tables.

near_dedup also links texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.  Texts that share one of 25 bands of 4 MinHash values
are candidates (a pair at 0.8 is missed with a probability of 2 in a million), and
within the components of candidates the similarity is that of the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import id_text, look_up, release, settle, table

SEED = 42
BANDS, BAND = 25, 4


def fingerprint(data: bytes, words: int = 4) -> int:
    """Unsigned fingerprint of UTF-8 bytes.  bytes.lower() and bytes.split() touch A-Z and \\x20 \\x09-\\x0D only."""
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate([[0], ends[:-words]]).tolist()
    ends = (ends[words - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 65536):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + 65536], ends[lo:lo + 65536])), np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fp (signed 64-bit), one row per input row; null counts as no words (zero)."""
    narrow = id_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            text = batch.column("text")
            data = text.cast(pa.binary()) if len(text) else []
            fps = np.array([fingerprint(x.as_py() or b"", words) for x in data], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2**(radius+1) - 1 masks such that any `radius` positions are outside at least one."""
    size = (1 << (radius + 1)) - 1
    code = [i % size + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (code[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def finer_masks(mask: int, radius: int, bits: int = 64) -> list[int]:
    """Masks that hold all of mask, such that two values that agree on mask and differ in at most `radius` positions agree on one of them."""
    free, size = [i for i in range(bits) if not mask >> i & 1], (1 << (radius + 1)) - 1
    return [mask | sum(1 << i for j, i in enumerate(free) if ((j % size + 1) & v).bit_count() & 1) for v in range(1, size + 1)]


def forest(fps: np.ndarray, radius: int):
    """Spanning forest (a, b pairs) of the links within radius; each member is compared with unreached ones only."""
    left = np.sort(fps)
    out = []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            a = todo.pop()
            near = np.bitwise_count(left ^ a) <= radius
            if near.any():
                got = left[near]
                left = left[~near]
                out += [(a, b) for b in got]
                todo += list(got)
    return out


def _buckets(radius: int):
    """Arrow function over rows sorted by group (t, k, bi, bj): links of each group."""
    def run(batches):
        key, held = None, []

        def close():
            links = forest(np.unique(np.concatenate(held)).view(np.uint64), radius) if held else []
            a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 1]), pa.array(a[:, 0])], names=["u", "v"])

        ready = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "k", "bi", "bj")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(fp)]):
                now = tuple(int(c[lo]) for c in cols)
                if now != key:
                    if held and sum(map(len, held)) > 1:
                        ready.append(close())
                    key, held = now, []
                held.append(fp[lo:hi].copy())
            if sum(x.num_rows for x in ready) > 10_000:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
                ready = []
        if held and sum(map(len, held)) > 1:
            ready.append(close())
        if rows := pa.Table.from_batches(ready).combine_chunks().to_batches() if ready else []:
            yield rows[0]

    return run


def _shared(rows: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """rows: t, k, fp -> the buckets (t, k) of several members with their number n, and the rows in them."""
    full = settle(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    return full, look_up(rows, full, ["t", "k"], "n", total)


def links(prints: DataFrame, radius: int = 4, block: int = 4096) -> DataFrame:
    """Links (u > v) that connect all distinct fingerprints within radius; prints has column fp, distinct.

    Members of a bucket above `block` are bucketed again by finer masks, which lose no
    pair within the radius; what is above `block` then has few bits left to differ in
    and is dealt out as pairs of blocks.
    """
    masks = covering_masks(radius)
    keyed = lambda ms, more: F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for t, m in more(ms)))
    rows = prints.select("fp", F.explode(keyed(masks, enumerate)).alias("x")).select("x.t", "x.k", "fp")
    full, shared = _shared(rows)
    if not full.where(F.col("n") > block).isEmpty():
        large, fine = shared.where(F.col("n") > block), None
        for t, m in enumerate(masks):
            own = keyed(finer_masks(m, radius), lambda ms, t=t: ((len(masks) * (t + 1) + j, x) for j, x in enumerate(ms)))
            fine = F.when(F.col("t") == t, own) if fine is None else fine.when(F.col("t") == t, own)
        again = large.select("fp", F.explode(fine).alias("x")).select("x.t", "x.k", "fp")
        shared = shared.where(F.col("n") <= block).unionByName(_shared(again)[1])
    shared = shared.withColumn("nb", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    parts = (
        shared.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("t", "k", "fp", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    )
    keys = ["t", "k", "bi", "bj"]
    found = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_buckets(radius), "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node of edges (u, v): root is the smallest node reachable."""
    def state(e):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    seen = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = look_up(both.where("v > u"), first, ["u"], "n", 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = look_up(large, least, ["u"], "n", 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        done = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(edges, first, large, least)
        edges, now = done, state(done)
        if now == seen:
            return edges.select("u", F.col("v").alias("root"))
        seen = now


def shingles(data: bytes, words: int = 5) -> np.ndarray:
    """Sorted hashes of the different shingles of a text; one of fewer words is one shingle, one of none has none."""
    parts = data.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(parts[i:i + words]), SEED) for i in range(max(len(parts) - words + 1, min(len(parts), 1)))), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A signed hash of each band of MinHash values."""
    r = np.random.default_rng(SEED)
    by = r.integers(0, 1 << 63, (2, BANDS * BAND, 1), np.uint64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), 4096):
        least = np.minimum(least, ((by[0] * 2 + 1) * hashes[lo:lo + 4096] + by[1]).min(axis=1))
    return [signed(xxhash.xxh64_intdigest(least[k * BAND:(k + 1) * BAND].tobytes(), k)) for k in range(BANDS)]


def set_forest(sets: list[np.ndarray], t: float) -> list[tuple[int, int]]:
    """Spanning forest (places a, b) of the links of Jaccard similarity t or more."""
    size, out, left = np.array([len(x) for x in sets]), [], np.arange(len(sets))
    flat = None
    while len(left) > 1:
        todo, left, flat = [left[0]], left[1:], None
        while todo and len(left):
            a = todo.pop()
            if flat is None:
                flat, first = np.concatenate([sets[i] for i in left]), np.concatenate([[0], np.cumsum(size[left])[:-1]])
            at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
            shared = np.add.reduceat((sets[a][at] == flat).astype(np.int64), first)
            near = shared >= t * (size[a] + size[left] - shared) - 1e-9
            if near.any():
                got, left, flat = left[near], left[~near], None
                out += [(a, b) for b in got]
                todo += list(got)
    return out


def similar(docs: DataFrame, words: int = 4, shingle: int = 5, t: float = 0.8, block: int = 2048, most: int = 2_000_000) -> DataFrame:
    """Links (u, v) of fingerprints that connect all texts whose sets of shingles have Jaccard similarity t or more.

    A component of candidates is dealt out as pairs of blocks of about `block` texts, or fewer where they are long: `most` shingles.
    """
    texts = docs.select("text").where("text IS NOT NULL")

    def sketch(batches):
        for batch in batches:
            rows = []
            for x in batch.column("text").cast(pa.binary()) if batch.num_rows else []:
                data = x.as_py()
                if parts := data.split():
                    own = shingles(data, shingle)
                    rows.append((signed(xxhash.xxh64_intdigest(b" ".join(parts).lower(), SEED)), signed(fingerprint(data, words)), len(own), bands(own)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["sig", "fp", "size", "bands"])

    def named(batches):
        for batch in batches:
            sigs = [signed(xxhash.xxh64_intdigest(b" ".join(x.as_py().split()).lower(), SEED)) for x in (batch.column("text").cast(pa.binary()) if batch.num_rows else [])]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), batch.column("text")], names=["sig", "text"])

    def joined(group: pa.Table) -> pa.Table:
        fp = group.column("fp").to_pylist()
        found = set_forest([shingles(x.as_py(), shingle) for x in group.column("text").cast(pa.binary())], t)
        return pa.table({"u": pa.array([fp[a] for a, _ in found], pa.int64()), "v": pa.array([fp[b] for _, b in found], pa.int64())})

    made = settle(texts.mapInArrow(sketch, "sig long, fp long, size long, bands array<long>"), "sketches")
    rows = made.select("sig", F.explode("bands").alias("k"))
    full = rows.groupBy("k").agg(F.min("sig").alias("top"), F.max("sig").alias("last")).where("top < last").drop("last")
    roots = components(rows.join(full, "k").select(F.col("sig").alias("u"), F.col("top").alias("v"))).withColumnRenamed("u", "sig")
    member = roots.unionByName(roots.select(F.col("root").alias("sig"), "root").distinct()).distinct().join(made.groupBy("sig").agg(F.min("fp").alias("fp"), F.min("size").alias("size")), "sig")
    member = settle(member, "candidates")
    groups = settle(member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / most)).cast("int").alias("nb"), F.count("*").alias("n")), "groups")
    member = look_up(member, groups, ["root"], "n").drop("n", "size")
    held = settle(texts.mapInArrow(named, "sig long, text string").join(member, "sig").dropDuplicates(["sig"]), "members")
    own = F.pmod(F.xxhash64("sig"), F.col("nb")).cast("int")
    parts = held.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    parts = parts.select("root", "fp", "text", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    return parts.groupBy("root", "bi", "bj").applyInArrow(joined, "u long, v long").where("u <> v")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = 4, radius: int = 4, block: int = 4096, more: DataFrame | None = None) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, kept.

    Texts are linked when their fingerprints differ in at most `radius` bits;
    component_id is the smallest doc_id reachable (null ids count last) and kept
    marks it.  Null, empty and blank texts have fingerprint zero and are linked
    like any other; fewer words than a shingle give one shingle.  Rows that repeat
    give repeated rows; an empty table gives an empty result; further columns of
    docs are ignored.  more: further links (u, v) of fingerprints.
    """
    prints = settle(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = links(nodes.select("fp"), radius, block)
    roots = components(found if more is None else found.unionByName(more)).withColumnRenamed("u", "fp")
    member = settle(nodes.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "member")
    smallest = settle(member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "smallest")
    of_fp = settle(look_up(member, smallest, ["root"], "size").select("fp", "n", "component_id"), "of_fp")
    return look_up(prints, of_fp, ["fp"], "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4, shingle: int = 5, t: float = 0.8) -> DataFrame:
    """The rows of docs (all columns) whose doc_id is its component's smallest; rows that share a doc_id stay or go together.

    Texts are linked by fingerprints within radius and by Jaccard similarity t or more.
    Texts without words are near copies of each other; rows with a null id stay
    together, if theirs is the smallest of the group; an empty table gives an empty
    result; further columns stay, whatever their names.
    """
    ids = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    kept = simhash_components(ids, words=words, radius=radius, more=similar(ids, words, shingle, t)).where("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")


def op1_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents")).drop("kept")
