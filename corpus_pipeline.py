"""From raw documents to packed training sequences.

quality -> near_duplicates -> secrets -> mix -> pack. Every stage takes (spark, docs, sf_dir) and works on all
that its predecessor kept; all but the last return the columns of documents. Each says in its operator what it
does with nulls, empty texts and repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candleforge.llm import mixing, packing, quality, secrets, simhash
from candleforge.llm.common import checkpointed, removed, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects.

    A null text is judged as an empty one; repeated rows share a verdict; texts are judged whole. Without labels every
    document stays; no documents give none.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingle sets of a similarity of 0.8 or more.

    The one with the least id stays, of its repeated rows one; null and empty texts are copies of each other; rows
    without an id stay; no documents give none.
    """
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; documents stay, null texts and repeated rows too. Contents that the shared ledger
    holds are not scanned again."""
    return secrets.redact(docs, ledger=secrets.BlobLedger.shared(spark))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their targets; a null source is the last one, null and empty texts
    have no size, repeated rows have equal lots, and no documents give none."""
    return mixing.repeated(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence; a document taken twice is packed twice, a null or empty text is a
    piece of its end id, and no documents give no pieces."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", clean_documents),
    ("mix", mixed_documents),
    ("pack", packed_documents),
]

#: Fingerprints, latent vectors, Newton steps and tokenisation have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again, and goes once its
    successor is written."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, out = out, written(stage(spark, out, sf_dir), name)
        if i:
            removed(before)
    packed = checkpointed(STAGES[-1][1](spark, out, sf_dir))
    removed(out)
    return packed
