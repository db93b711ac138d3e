"""Rewriting a stored index: compression, block size, and the order of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sequences import random_sequence, with_ids
from .index import Index, write
from .query import query


def similar_order(index: Index, cells: int = 20_000, group: int = 0) -> list[int]:
    """Samples in a greedy order of likeness, by their presence in at most ``cells`` sampled keys.

    The keys are those of the smallest hashes; a bound on the hash keeps all others out of the sort.

    With ``group``, a multiple of 8, only samples within each run of so many are reordered.
    Each sample follows the one that it shares most of the sampled keys with; what reaches
    the driver is a table of samples by samples.
    """
    key = index.params.key
    hashed, n = F.xxhash64(*key), len(index.samples)
    total = index.rows.count()  # at least so many keys as there are rows a sample
    bound = (4 * cells * max(1, n) << 64) // max(1, total) - (1 << 63)
    near = index.rows.select(*key).where(hashed <= bound).distinct() if bound < 1 << 63 else None
    if near is None or near.count() < cells:
        near = index.rows.select(*key).distinct()
    keys = near.orderBy(hashed).limit(cells)
    rows = index.rows.join(F.broadcast(keys), key).groupBy(*key).agg(F.sort_array(F.collect_set("sample_idx")).alias("s"))
    pairs = rows.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").count()
    shared = {(r.a, r.b): r["count"] for r in pairs.collect()}
    size = [shared.get((k, k), 0) for k in range(n)]
    if group < 0 or group % 8:
        raise ValueError("the group must be a multiple of 8")
    order: list[int] = []
    for first in range(0, n, group or max(n, 1)):
        left = set(range(first + 1, min(n, first + (group or n))))
        order.append(first)
        while left:
            last = order[-1]
            order.append(min(left, key=lambda k: (size[last] + size[k] - 2 * shared.get((last, k), 0), k)))
            left.remove(order[-1])
    return order


def reorder(index: Index, order: list[int]) -> Index:
    """The index with its samples in another order."""
    if sorted(order) != list(range(len(index.samples))):
        raise ValueError("the order must have every sample once")
    spark = index.rows.sparkSession
    places = spark.createDataFrame([(old, k) for k, old in enumerate(order)], "old int, new int")  # a row a sample
    joined = index.rows.join(F.broadcast(places), F.col("sample_idx") == F.col("old"))
    rows = joined.withColumn("sample_idx", F.col("new")).select(*index.rows.columns)
    return Index(index.params, tuple(index.samples[k] for k in order), rows, "split" if index.order else "")


def rewrite(index: Index, path: str, level: int = 6, block_mb: int = 8, similar: bool = False, check: bool = False, files_per_partition: int | None = None, sampling: int = 20_000, group: int = 0) -> Index:
    """Store the index anew with zstandard at ``level``; returns the stored index.

    ``check`` compares a random query before and after and raises if any ratio differs.
    """
    if not 1 <= level <= 22:
        raise ValueError("the level must be between 1 and 22")
    spark = index.rows.sparkSession
    out = reorder(index, similar_order(index, sampling, group)) if similar else index
    write(out, path, files_per_partition, "zstd", level, block_mb)
    stored = out.with_rows(spark.read.parquet(path).select(*out.rows.columns), "split")
    if check:
        seqs = with_ids(random_sequence(spark, 2_000))
        gap = query(index, seqs, 0).select("sample", "ratio", "class").exceptAll(query(stored, seqs, 0).select("sample", "ratio", "class"))
        if not gap.isEmpty():
            raise RuntimeError("the rewritten index answers differently")
    return stored
