"""Summaries: in how many samples a cell occurs, and queries on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encode import corrected
from ..sources.sequences import random_sequence, with_ids
from .index import Index
from .query import long_enough, prepare, query


def summarise(index: Index, correction: float = 0.0) -> DataFrame:
    """(key.., n_samples): samples a key, less the share expected to be false.

    Abundance indexes have no summary.
    """
    if index.params.bits != 1:
        raise ValueError("only a presence index can be summarised")
    counted = index.rows.groupBy(*index.params.key).agg(F.count("*").alias("n"))
    return counted.select(*index.params.key, corrected(F.col("n"), len(index.samples), correction).alias("n_samples"))


def estimate_correction(index: Index, length: int = 10_000, seed: int = 0) -> float:
    """The mean ratio of a random sequence over the samples: the share of false hits."""
    seqs = with_ids(random_sequence(index.rows.sparkSession, length, seed))
    return query(index, seqs, 0).agg(F.avg("ratio")).first()[0] or 0.0


def query_summary(index: Index, sums: DataFrame, seqs: DataFrame) -> DataFrame:
    """(qid, name, counts): the sample counts of each k-mer of each sequence of k + 1 bases or more."""
    words = prepare(seqs, index.params, 1)
    known = words.join(sums, index.params.key).select(F.col("qid").alias("q"), "pos", "n_samples")
    lists = known.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("pos", "n_samples"))).alias("found"))
    asked = long_enough(seqs, index.params.k, 0, 1).select("qid", "name", (F.length("seq") - index.params.k + 1).alias("n"))
    joined = asked.join(lists, F.col("qid") == F.col("q"), "left")
    from .query import dense_positions

    as_classes = F.transform("found", lambda x: F.struct(x.pos.alias("pos"), x.n_samples.cast("int").alias("cls")))
    return joined.select("qid", "name", dense_positions(as_classes, F.col("n")).alias("counts"))
