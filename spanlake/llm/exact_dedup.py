"""Exact dedup by a tree-merge of sorted digest runs (DataFrame operations only).

Every input partition is a leaf.  Its texts become a run of (digest, newest row,
count).  Then come binomial rounds, as in a recursive-halving reduce: nodes whose
numbers differ in the next bits only exchange parts of their runs, and each merges
the sorted parts it gets, keeping one row per digest.  After the last round every
digest lives on one node.  A digest that a third of all rows share is one row per
leaf and node from the first merge on, never a large group.

Verified: the key is SHA-256 with the byte length and an independent 64-bit hash,
so two texts would have to agree in all three to be taken for equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import fold_case, id_text, look_up, settle, table

KEY = ["digest", "bytes", "proof"]


def stamp(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: rid (distinct), doc_id and the digest key; null text counts as empty."""
    text = fold_case(F.coalesce(F.col("text"), F.lit("")))
    return id_text(docs, id_col, text_col).select(
        "doc_id",
        F.monotonically_increasing_id().alias("rid"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).alias("bytes"),
        F.xxhash64(text).alias("proof"),
    )


def nodes_of(spark) -> int:
    """The logarithm of the number of nodes: as many as the session has shuffle partitions, rounded down to a power of two."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() - 1)


def merged(runs: DataFrame) -> DataFrame:
    """Each node's runs merged to one: sorted by the key, of equal keys the newest row and the sum of counts.

    Where rows lie by node this moves none: the aggregate needs them sorted by node
    and key, which a merge of what has arrived sorted gives.
    """
    return runs.groupBy("node", *KEY).agg(F.max("top").alias("top"), F.sum("n").alias("n"))


def tree_merge(stamped: DataFrame, nodes_log2: int | None = None, radix_bits: int = 3) -> DataFrame:
    """(digest, bytes, proof) -> top (doc_id, rid of the row that stays), group_size.

    Node k owns partition k.  In a round every node cuts its run by the next
    `radix_bits` bits of its keys' places, keeps the part of its own number and sends
    each other part to the partner whose number has those bits.
    """
    log2 = nodes_of(stamped.sparkSession) if nodes_log2 is None else nodes_log2
    place = F.pmod(F.col("proof"), F.lit(1 << log2)).cast("int")
    runs = stamped.select(
        F.pmod(F.spark_partition_id(), F.lit(1 << log2)).cast("int").alias("node"),
        *KEY, F.struct("doc_id", "rid").alias("top"), F.lit(1).cast("long").alias("n"),
    )
    for low in range(0, log2, radix_bits):
        bits = ((1 << min(radix_bits, log2 - low)) - 1) << low
        partner = F.col("node").bitwiseAND(F.lit(~bits)).bitwiseOR(place.bitwiseAND(F.lit(bits)))
        runs = merged(runs.withColumn("node", partner).repartitionById(1 << log2, "node"))
    return runs.select(*KEY, "top", F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                nodes_log2: int | None = None, radix_bits: int = 3) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    Of equal texts the row with the largest doc_id stays; of rows that repeat that
    doc_id, one.  A null doc_id sorts below every other.  An empty table gives an
    empty result; further columns of docs are ignored.
    """
    stamped = settle(stamp(docs, id_col, text_col), "digests")
    winners = settle(tree_merge(stamped, nodes_log2, radix_bits), "winners")
    rows = look_up(stamped, winners, KEY, "group_size")
    return rows.select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


OP9_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""
