"""The inverted index: Parquet tables under one folder, one generation per write.

  postings  gen, bucket | term, doc_id, field, positions, tf, dl, first   sorted by term
  terms     gen, bucket | term, df, max_tf  (df: distinct documents over fields)
  stats     gen | n_docs, total_length, field_totals
  dead      gen | doc_id, upto              (dead in generations up to `upto`)
  meta      one row of JSON: analyzer, fields, weights, buckets

`bucket` is a hash of the term: a lookup of exact terms prunes to their folders and,
inside, to row groups by the sort.  A frequent term's postings are dealt over
`spread` files by document, so no task or file holds a hot term alone.  A posting
has its document's length, so ranking reads nothing else; `first` marks one posting
of those that a document has of a term in several fields, so that counting documents
takes no grouping by document.  Bucket -1 has a row per document with tokens: tf is
its length, positions are the lengths of its fields.

Tokens are grouped by term where their documents are read, SLICE of them at a time,
and packed by file: one exchange of compressed packets, to as many partitions as the
input needs, then brings the postings to their files.
"""

from __future__ import annotations

import json
import math
import uuid
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanlake import ship
from spanlake.functions.analysis import Analyzer, AnalyzerSpec, token_count
from spanlake.plans.parser import QueryError
from spanlake.settings import setting
from spanlake.sources.scratch import shared_dir

POSTINGS = "term string, doc_id {id}, field int, positions array<int>, tf int, dl int, first boolean, gen int, bucket int"
ROW = "term string, doc_id {id}, field int, positions array<int>, tf int, dl int, first boolean, bucket int"
PACKET = "place int, size int, body binary"
TERMS = "term string, df long, max_tf int, gen int, bucket int"
FILE_BYTES = 32 << 20  # of input for one file of postings
MOST_FILES = 1 << 18
SLICE = 400_000  # tokens that an executor's Python groups at a time
PACKED = 50_000  # postings that it unpacks at a time
UNKNOWN = 1 << 55  # what Spark takes for the size of rows that aren't from a table
ANALYSIS = 1  # goes up when the same options give other tokens
STATS = "n_docs long, total_length long, field_totals array<long>, gen int"
DEAD = "doc_id {id}, upto int, gen int"


def bucket_number(term: str, buckets: int) -> int:
    """A term's bucket, as bucket_of gives it."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets


def _packet(place: int, rows: pa.RecordBatch, codec: pa.Codec) -> tuple[int, int, bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    body = sink.getvalue()
    return place, body.size, codec.compress(body, asbytes=True)


def _packets(found: list) -> pa.RecordBatch:
    place, size, body = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(body, pa.binary())], names=["place", "size", "body"])


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1]) if len(keys) else np.zeros(0, np.int64)


def _runs(keys: np.ndarray):
    cuts = _starts(keys).tolist()
    return zip(cuts, [*cuts[1:], len(keys)])


def _slices(batch: pa.RecordBatch, n_fields: int):
    """Rows of a batch with about SLICE tokens, or one."""
    weight = np.ones(batch.num_rows, np.int64)
    for f in range(n_fields):
        if f"w{f}" in batch.schema.names:
            weight += pc.fill_null(pc.list_value_length(batch.column(f"w{f}")), 0).to_numpy(zero_copy_only=False)
        weight += pc.fill_null(pc.binary_length(batch.column(f"t{f}")), 0).to_numpy(zero_copy_only=False) // 3
    for a, b in _runs(np.cumsum(weight) // SLICE):
        yield batch.slice(a, b - a)


def _grouped(n_fields: int, spec: AnalyzerSpec, buckets: int, spread: int):
    """Arrow function: doc_id, part and, by field, the text t, or tokens w of texts that are null -> packets of postings and of documents."""
    def postings(batch, analyzer):
        """Postings of some documents, sorted by part, bucket, term, row and field, their places, and lengths by field."""
        n, part = batch.num_rows, batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64)
        lengths, rows, places, terms, fields = np.zeros((n_fields, n), np.int64), [], [], [], []
        for f in range(n_fields):
            texts = batch.column(f"t{f}")
            words = batch.column(f"w{f}") if f"w{f}" in batch.schema.names else pa.nulls(n, pa.list_(pa.string()))
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(n), size)
            own = [row], [np.arange(len(row)) - np.repeat(size.cumsum() - size, size)], [pc.list_flatten(words).cast(pa.string())]
            spoken, counts, spots = [], np.zeros(n, np.int64), []
            for i, text in enumerate(texts):
                if (text := text.as_py()) is not None:
                    found, at = analyzer.words(text)
                    spoken += found
                    counts[i] = len(found)
                    spots.append(np.asarray(at, np.int64))
            for x, more in zip(own, (np.repeat(np.arange(n), counts), np.concatenate(spots or [np.zeros(0, np.int64)]), pa.array(spoken, pa.string()))):
                x.append(more)
            row = np.concatenate(own[0])
            lengths[f] = np.bincount(row, minlength=n)
            rows.append(row)
            places.append(np.concatenate(own[1]))
            terms += own[2]
            fields.append(np.full(len(row), f))
        row, total = np.concatenate(rows), lengths.sum(axis=0)
        coded = pa.concat_arrays(terms).dictionary_encode()
        words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        bucket = np.array([bucket_number(t, buckets) for t in words.to_pylist()], np.int64)
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        in_order = np.empty(len(words), np.int64)
        in_order[np.lexsort((rank, bucket))] = np.arange(len(words))
        key = ((part[row] * len(words) + in_order[code]) * n + row) * n_fields + np.concatenate(fields)
        order = np.argsort(key, kind="stable")  # positions stay in their order
        key = key[order]
        starts = _starts(key)
        head, code, key = row[order[starts]], code[order[starts]], key[starts]
        ends = np.append(starts, len(order)).astype(np.int32)
        document = key // n_fields
        posts = pa.RecordBatch.from_arrays([
            words.take(pa.array(code)), batch.column("doc_id").take(pa.array(head)), pa.array((key % n_fields).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(places)[order].astype(np.int32))),
            pa.array(np.diff(ends)), pa.array(total[head].astype(np.int32)), pa.array(np.concatenate([[True], document[1:] != document[:-1]])[:len(document)]),
        ], names=["term", "doc_id", "field", "positions", "tf", "dl", "first"])
        return posts, bucket[code] * spread + part[head], part, lengths

    def run(batches):
        analyzer, codec = Analyzer(spec), pa.Codec("zstd")
        for whole in batches:
            for batch in _slices(whole, n_fields):
                posts, place, part, lengths = postings(batch, analyzer)
                found = [_packet(int(place[a]), posts.slice(a, b - a), codec) for a, b in _runs(place)]
                total = lengths.sum(axis=0)
                held = np.flatnonzero(total)
                held = held[np.argsort(part[held], kind="stable")]
                own = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * n_fields), pa.array(lengths[:, held].T.ravel().astype(np.int32)))
                size = pa.array(total[held].astype(np.int32))
                docs = pa.RecordBatch.from_arrays([
                    pa.repeat(pa.scalar("", pa.string()), len(held)), batch.column("doc_id").take(pa.array(held)), pa.repeat(pa.scalar(-1, pa.int32()), len(held)), own, size, size, pa.repeat(pa.scalar(True), len(held)),
                ], names=["term", "doc_id", "field", "positions", "tf", "dl", "first"])
                found += [_packet(buckets * spread + int(part[held[a]]), docs.slice(a, b - a), codec) for a, b in _runs(part[held])]
                if found:
                    yield _packets(found)

    return run


def _repacked(batches):
    """Arrow function: rows with their place -> packets."""
    codec = pa.Codec("zstd")
    for batch in batches:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        order = np.argsort(place, kind="stable")
        rows = pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names if c != "place"], names=[c for c in batch.schema.names if c != "place"])
        rows, place = (rows, place) if (order[1:] > order[:-1]).all() else (rows.take(pa.array(order)), place[order])
        if len(place):
            yield _packets([_packet(int(place[a]), rows.slice(a, b - a), codec) for a, b in _runs(place)])


def _unpacked(buckets: int, spread: int):
    """Arrow function: packets -> rows with their bucket."""
    def run(batches):
        codec, held, rows = pa.Codec("zstd"), [], 0
        for batch in batches:
            for place, size, body in zip(batch.column("place").to_pylist(), batch.column("size").to_pylist(), batch.column("body")):
                part = pa.ipc.open_stream(codec.decompress(body.as_buffer(), size)).read_all()
                bucket = place // spread if place < buckets * spread else -1
                held.append(part.append_column("bucket", pa.repeat(pa.scalar(bucket, pa.int32()), len(part))))
                rows += len(part)
                if rows >= PACKED:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


class Index:
    """A handle on one version of an index; writes return a new handle, old ones keep their view."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path.rstrip("/"), meta
        self.fields: list[str] = meta["fields"]
        self.weights: list[float] = meta["weights"]
        self.analyzer = Analyzer(AnalyzerSpec(**meta["analyzer"]))

    # ---------------------------------------------------------------- writing
    @classmethod
    def build(cls, df: DataFrame, fields: list[str] | str, id_col: str = "doc_id", path: str | None = None, spec: AnalyzerSpec | None = None,
              weights: dict[str, float] | None = None, buckets: int | None = None, spread: int = 4) -> Index:
        """Index the text columns `fields` (1 to 16) of df; id_col identifies rows.

        Null and empty documents are left out.  Null ids are refused by verify().
        buckets * spread files are written; by default one for each 32 MB
        of df, or as many as there are shuffle partitions where its size isn't known.
        """
        fields = [fields] if isinstance(fields, str) else list(fields)
        if not 1 <= len(fields) <= 16:
            raise QueryError("an index has 1 to 16 fields")
        weights = weights or {}
        if unknown := set(weights) - set(fields):
            raise QueryError(f"weights for unknown fields {sorted(unknown)}")
        if any(not 0 < w < float("inf") for w in weights.values()):
            raise QueryError("field weights must be positive")
        spark = df.sparkSession
        ship(spark)
        path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        if buckets is None:
            leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join's own estimate is the product of its sides
            size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
            files = size // FILE_BYTES if size < UNKNOWN else int(spark.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(2, -(-min(files, MOST_FILES) // spread))
        meta = {
            "analyzer": (spec or AnalyzerSpec()).to_dict(), "analysis": ANALYSIS, "fields": fields, "weights": [float(weights.get(f, 1.0)) for f in fields],
            "buckets": buckets, "spread": spread, "firsts": True, "id": df.schema[id_col].dataType.simpleString(), "gens": [],
        }
        return cls(spark, path, meta)._write(df, id_col, 0, [])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        ship(spark)
        rows = spark.read.schema("json string, version int").parquet(f"{path.rstrip('/')}/meta").orderBy(F.desc("version")).limit(1).collect()
        return cls(spark, path, json.loads(rows[0]["json"]))

    def _save_meta(self, **change) -> Index:
        """The next version; of two writers that started from one version the second fails here."""
        meta = self.meta | change
        meta["version"] = self.meta.get("version", 0) + 1
        self.spark.range(1).select(F.lit(json.dumps(meta)).alias("json")).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/meta/version={meta['version']}")
        return Index(self.spark, self.path, meta)

    def _texts(self, df: DataFrame, id_col: str) -> DataFrame:
        """doc_id and the fields' texts t0, t1, ..., in partitions enough for the cores."""
        rows = df.select(F.col(id_col).alias("doc_id"), *(F.col(f).cast("string").alias(f"t{i}") for i, f in enumerate(self.fields)))
        cores = self.spark.sparkContext.defaultParallelism
        if self.meta["buckets"] <= cores and rows._jdf.rdd().getNumPartitions() < cores:  # few splits of a small input would leave cores idle
            rows = rows.repartition(cores)
        return rows

    def _write(self, df: DataFrame, id_col: str, gen: int, gens: list[int]) -> Index:
        m = self.meta
        part = F.pmod(F.xxhash64("doc_id"), F.lit(m["spread"])).cast("int").alias("part")
        packets = self._texts(df, id_col).select("*", part).mapInArrow(_grouped(len(self.fields), self.analyzer.spec, m["buckets"], m["spread"]), PACKET)
        return self._lay(packets, gen)._save_meta(gens=[*gens, gen], next=gen + 1)

    def _lay(self, packets: DataFrame, gen: int) -> Index:
        """Write packets of postings and documents as a generation, each file by one task, then its dictionary and totals."""
        m, at = self.meta, f"gen={gen}"
        laid = packets.repartitionById((m["buckets"] + 1) * m["spread"], "place").mapInArrow(_unpacked(m["buckets"], m["spread"]), ROW.format(id=m["id"]))
        laid.sortWithinPartitions("bucket", "term", "doc_id", "field").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/postings/{at}")
        df = F.count_if("first") if len(self.fields) > 1 else F.count("*")
        terms = self._postings([gen]).groupBy("bucket", "term").agg(df.alias("df"), F.max("tf").alias("max_tf")).repartitionById(m["buckets"], "bucket")
        terms.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.path}/terms/{at}")
        totals = [F.coalesce(F.sum(F.get("field_dl", F.lit(i)).cast("long")), F.lit(0).cast("long")) for i in range(len(self.fields))]
        self._docs([gen]).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0).cast("long")).alias("total_length"), F.array(*totals).alias("field_totals")) \
            .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats/{at}")
        return self

    def append(self, df: DataFrame, id_col: str = "doc_id") -> Index:
        """Index more rows as a generation of their own, searchable at once."""
        return self._write(df, id_col, self.meta["next"], self.meta["gens"])

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> Index:
        """Mark documents dead; statistics keep them until compact()."""
        gen = self.meta["next"]
        ids.select(F.col(id_col).alias("doc_id"), F.lit(gen).alias("upto")).distinct().write.mode("overwrite").parquet(f"{self.path}/dead/gen={gen}")
        return self._save_meta(dead=[*self.meta.get("dead", []), gen], next=gen + 1)

    def update(self, df: DataFrame, id_col: str = "doc_id") -> Index:
        """New versions of documents: the old ones die, the new ones are appended."""
        return self.delete(df.select(id_col), id_col).append(df, id_col)

    def _merged(self, gens: list[int]) -> Index:
        """Those generations' live rows as one generation; the others stay as they are."""
        gen, left = self.meta["next"], [g for g in self.meta["gens"] if g not in gens]
        rows, m = self._live(self._read("postings", POSTINGS, gens)), self.meta
        if len(self.fields) > 1 and not m.get("firsts"):  # an index from before `first`
            rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("bucket", "term", "doc_id").orderBy("field")) == 1)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(m["spread"])).cast("int")
        place = F.when(F.col("bucket") < 0, F.lit(m["buckets"])).otherwise(F.col("bucket")) * m["spread"] + part
        packets = rows.select("term", "doc_id", "field", "positions", "tf", "dl", "first", place.alias("place")).mapInArrow(_repacked, PACKET)
        self._lay(packets, gen)
        return self._save_meta(gens=[*left, gen], dead=self.meta.get("dead", []) if left else [], next=gen + 1)

    def compact(self) -> Index:
        """Rewrite all live postings as one generation and forget the dead."""
        return self._merged(self.meta["gens"])

    def merge(self, fan: int = 8) -> Index:
        """Tiered merge: wherever fan generations are of about one size, by powers of fan, they become one.

        A posting is rewritten once a tier, so the work grows with the logarithm of the index's size.
        """
        index = self
        while True:
            sizes = {r["gen"]: r["n_docs"] for r in index._read("stats", STATS, index.meta["gens"]).select("gen", "n_docs").collect()}  # a row a generation
            tiers: dict[int, list[int]] = {}
            for g in index.meta["gens"]:
                tiers.setdefault(int(math.log(max(1, sizes.get(g, 0)), fan) + 1e-9), []).append(g)
            full = next((t for _, t in sorted(tiers.items()) if len(t) >= fan), None)
            if full is None:
                return index
            index = index._merged(full)

    # ---------------------------------------------------------------- reading
    def _read(self, name: str, schema: str, gens: list[int]) -> DataFrame:
        full = StructType.fromDDL(schema.format(id=self.meta["id"]))
        if not gens:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/gen={g}" for g in gens))

    def _postings(self, gens: list[int]) -> DataFrame:
        return self._read("postings", POSTINGS, gens).where("bucket >= 0")

    def _docs(self, gens: list[int]) -> DataFrame:
        return self._read("postings", POSTINGS, gens).where("bucket = -1").select("doc_id", "dl", F.col("positions").alias("field_dl"), "gen")

    @cached_property
    def dead(self) -> DataFrame | None:
        gens = self.meta.get("dead") or []
        return self._read("dead", DEAD, gens).groupBy("doc_id").agg(F.max("upto").alias("upto")) if gens else None

    def _live(self, df: DataFrame) -> DataFrame:
        if self.dead is None:
            return df
        dead = self.dead.withColumnRenamed("doc_id", "dead_id")
        return df.join(dead, (F.col("doc_id") == F.col("dead_id")) & (F.col("gen") < F.col("upto")), "left_anti")

    @cached_property
    def postings(self) -> DataFrame:
        return self._live(self._postings(self.meta["gens"]))

    @cached_property
    def docs(self) -> DataFrame:
        return self._live(self._docs(self.meta["gens"]))

    @cached_property
    def terms(self) -> DataFrame:
        """The dictionary: term, df, max_tf, bucket; dead documents count until compact()."""
        rows = self._read("terms", TERMS, self.meta["gens"])
        if len(self.meta["gens"]) == 1:
            return rows.drop("gen")
        return rows.groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"))

    def bucket_number(self, term: str) -> int:
        """A term's bucket, as bucket_of gives it."""
        return bucket_number(term, self.meta["buckets"])

    def bucket_numbers(self, terms: list[str]) -> list[int]:
        return sorted({self.bucket_number(t) for t in terms})

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """Document frequency of each term, from the dictionary; dead documents count until compact()."""
        if not terms:
            return {}
        if len(terms) <= 1000:
            rows = self.terms.where(F.col("bucket").isin(self.bucket_numbers(terms)) & F.col("term").isin(terms))
        else:
            named = self.spark.createDataFrame([(self.bucket_number(t), t) for t in terms], "bucket int, term string")
            rows = self.terms.join(F.broadcast(named), ["bucket", "term"], "left_semi")  # as many as a query has
        return {r["term"]: r["df"] for r in rows.select("term", "df").collect()}

    @cached_property
    def totals(self) -> tuple[int, int, list[int]]:
        """N, total length, lengths by field: one row per generation is read."""
        rows = self._read("stats", STATS, self.meta["gens"]).collect()
        return sum(r["n_docs"] for r in rows), sum(r["total_length"] for r in rows), [sum(r["field_totals"][i] for r in rows) for i in range(len(self.fields))]

    # ------------------------------------------------------------- inspection
    def segment_info(self) -> DataFrame:
        """One row per generation: documents, dead documents, terms, postings, tokens."""
        gens = self.meta["gens"]
        docs = self._docs(gens)
        alive = self._live(docs).groupBy("gen").agg(F.count("*").alias("live"))
        terms = self._read("terms", TERMS, gens).groupBy("gen").agg(F.count("*").alias("n_terms"), F.max("max_tf").alias("max_tf"))
        posts = self._postings(gens).groupBy("gen").agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens"))
        return (
            docs.groupBy("gen").agg(F.count("*").alias("n_docs"), F.min("dl").alias("min_length"), F.max("dl").alias("max_length"))
            .join(alive, "gen", "left").join(terms, "gen").join(posts, "gen")
            .select("gen", "n_docs", (F.col("n_docs") - F.coalesce("live", F.lit(0))).alias("n_dead"), "n_terms", "n_postings", "n_tokens", "min_length", "max_length", "max_tf")
        )

    def index_stats(self) -> DataFrame:
        """One row on the whole index, with its state of health."""
        s = self.segment_info().agg(
            F.count("*").alias("generations"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_dead"), F.lit(0)).alias("n_dead"),
            F.sum("n_postings").alias("n_postings"), F.sum("n_tokens").alias("n_tokens"), F.max("max_length").alias("max_length"),
        )
        n = self.terms.agg(F.count("*").alias("n_terms"), F.max("df").alias("max_df"))
        avgdl = F.when(F.col("n_docs") > 0, F.col("n_tokens").cast("float") / F.col("n_docs").cast("float")).otherwise(F.lit(1.0).cast("float"))
        share = F.when(F.col("n_docs") > 0, F.col("n_dead") / F.col("n_docs")).otherwise(0.0)
        return s.crossJoin(n).select(  # two rows of totals
            "generations", "n_docs", "n_dead", "n_terms", "max_df", "n_postings", "n_tokens", "max_length", avgdl.cast("float").alias("avgdl"),
            F.lit(len(self.fields)).alias("n_fields"), share.alias("dead_share"),
            F.when(share > 0.2, "compact: many dead").when(F.col("generations") > 8, "compact: many generations").otherwise("ok").alias("health"),
        )

    def index_analysis(self, spec: AnalyzerSpec | None = None) -> DataFrame:
        """The stored analysis options beside those of spec (by default this library's own), the analysis version, and whether tokens would differ."""
        stored, now = self.meta["analyzer"] | {"analysis_version": self.meta.get("analysis", 0)}, (spec or AnalyzerSpec()).to_dict() | {"analysis_version": ANALYSIS}
        names = dict.fromkeys([*stored, *now])
        rows = [(k, str(stored.get(k, "absent")), str(now.get(k, "absent")), stored.get(k) != now.get(k), "rebuild" if stored.get(k) != now.get(k) else "none") for k in names]
        return self.spark.createDataFrame(rows, "option string, stored string, runtime string, drifted boolean, action string")

    def check_analysis(self) -> None:
        """With the setting strict_analysis, refuses an index whose analysis isn't this library's."""
        if self.meta.get("analysis", 0) != ANALYSIS and setting(self.spark, "strict_analysis"):
            raise QueryError("the index was built by another version of the analysis: rebuild it")

    def forward(self, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """doc_id, field, words (map of word to positions): the whole record of some documents."""
        held = self.postings.join(ids.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
        return held.groupBy("doc_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("words"))

    def verify(self, source: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
        """severity, location, message of every inconsistency; with source, against the rows themselves."""
        posts, docs = self.postings, self.docs
        place = F.concat(F.lit("doc "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))

        def say(rows, where, *faults):
            """A row of the report for each fault (condition, message, severity) of a row."""
            told = F.array(*(F.when(cond, F.struct(F.lit(severity).alias("severity"), where.alias("location"), F.lit(what).alias("message"))) for cond, what, severity in faults))
            return rows.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("x")).select("x.*")

        held = posts.groupBy("doc_id").agg(F.sum("tf").alias("held")).withColumnRenamed("doc_id", "held_id")
        own = docs.select("doc_id", "dl", F.lit(True).alias("known"))
        size = F.size("positions")
        found = [
            say(own.join(held, F.col("doc_id") == F.col("held_id"), "full").withColumn("doc_id", F.coalesce("doc_id", "held_id")), place,
                (F.col("known").isNull(), "postings without a document", "error"),
                (F.col("known").isNotNull() & ~F.col("dl").eqNullSafe(F.col("held")), "length differs from its postings", "error")),
            say(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL"), place, (F.lit(True), "repeated or null document id", "error")),
            say(posts, F.concat(F.lit("term "), F.col("term")),
                ((size != F.col("tf")) | F.when(size != 1, ~F.col("positions").eqNullSafe(F.array_distinct(F.sort_array("positions")))).otherwise(F.lit(False)), "positions don't ascend or don't count up to tf", "error"),
                (bucket_of(F.col("term"), self.meta["buckets"]) != F.col("bucket"), "posting in the wrong bucket", "error")),
        ]
        if source is not None:
            count = [F.coalesce(token_count(F.col(f"t{i}"), self.analyzer.spec), F.lit(0)) for i in range(len(self.fields))]
            there = self._texts(source, id_col).select(F.col("doc_id").alias("row_id"), sum(count, F.lit(0)).alias("n"))
            found.append(say(there.join(own, F.col("row_id") == F.col("doc_id"), "full").withColumn("doc_id", F.coalesce("doc_id", "row_id")), place,
                             (F.col("known").isNull() & (F.col("n") > 0), "row isn't indexed", "error"),
                             (F.col("known").isNotNull() & ~F.col("dl").eqNullSafe(F.col("n")), "row has gone or changed", "warning")))
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out
