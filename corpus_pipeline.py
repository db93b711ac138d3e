"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all the rows that its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.  Between the
stages the rows are written as Parquet and read again.

Nulls, empty texts and repeated rows go by each operator's own rules: a null text counts as
empty; empty texts have the score of texts without evidence, are one group of exact copies,
are near copies of nothing, and are packed as the end id alone; rows with a null id are
documents like others, but near-dedup keeps them all.  Extra columns are carried along
whatever their names, and empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merlake.llm import exact_dedup, near_dedup, packing, quality
from merlake.llm.common import held_out, materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below 0.7 go."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each group of equal texts stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on five-word shingles at 0.8: one document of each group stays."""
    return near_dedup.drop_near(docs, words=5, share=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1,024 tokens."""
    ranks = packing.load_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    added = packing.load_added(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(packing.pieces(docs, ranks, public_tokenizers.PATTERN, end_id=2, added=added))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: No SQL expresses the trained classifier, so the whole has none either.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
