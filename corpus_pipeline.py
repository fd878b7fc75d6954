"""A corpus pipeline of five of the training-text operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet to the folder all executors share and read again for the next stage.
All columns of docs stay, whatever their names, but for the last stage.  Null ids
stay ids, null texts stay null; an empty table gives an empty one.
"""

from __future__ import annotations

from spanlake.llm.byte_bpe import bpe_encode
from spanlake.llm.common import settle, table
from spanlake.llm.decontaminate import decontaminate
from spanlake.llm.line_dedup import line_dedup
from spanlake.llm.quality_gam import keep_good
from spanlake.llm.simhash import near_dedup


def quality(spark, docs, sf_dir):
    """Documents that the quality classifier rejects go; without labels none does.  Null texts are scored as empty ones."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark, docs, sf_dir):
    """Later lines that match an earlier one go, and rows of which nothing else is left.

    Null, empty and blank texts stay as they are.  Rows that share an id are
    documents of their own; those that also share the text stay or go together.
    """
    return line_dedup(docs)


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays; texts without words are one group.  Rows that share an id stay or go together."""
    return near_dedup(docs)


def clean(spark, docs, sf_dir):
    """Documents that hold a benchmark item go.  Null ids and null texts stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """doc_id, token ids and digests of what is left, a row each; a null text counts as empty."""
    return bpe_encode(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontaminate", clean), ("bpe_encode", encode)]

#: The classifier's stage can't be expressed in SQL; the tests hold the stages to brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage-{name}")
    return docs
