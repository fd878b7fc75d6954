"""What the operators of this subpackage share: table access, shared scratch tables, split rules."""

from __future__ import annotations

import atexit
import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import ship
from spanlake.sources.scratch import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone at exit
        pass


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def release(*settled: DataFrame) -> None:
    """Remove settled tables that no plan still to be run reads."""
    for df in settled:
        _remove(df.sparkSession, df.settled_at)


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only.  Texts of one-byte characters take the vectorised path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def bucket_of(id_col: str, k: int) -> Column:
    """crc32 of the id as text, modulo k (null ids: bucket of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % k


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names: extra or clashing columns can't interfere."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def parts_of(batch, column: str, most: int, rows: int):
    """Slices of an Arrow batch: of no more than `rows` rows, or `most` bytes of a text column but for single rows."""
    ends = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum() if batch.num_rows else ()
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(ends.searchsorted(before + most, "right"))))
        yield batch.slice(at, to - at)
        at = to


def look_up(rows: DataFrame, right: DataFrame, keys: list[str], size: str, total: int | None = None, most: int = 20_000) -> DataFrame:
    """Inner join of rows with right, which has a row per key and, in column size, how many of rows have it.

    Keys that more than a most-th of all rows have, fewer than most of them by that,
    are broadcast, so their rows stay where they are; the rest is joined by a shuffle
    in which no key is large.  right should be a settled table: it is read twice.
    """
    if total is None:
        total = right.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) > max(1, total // most)
    large = right.where(hot)
    if large.isEmpty():
        return rows.join(right, keys)
    return rows.join(F.broadcast(large), keys).unionByName(rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(right.where(~hot), keys))
