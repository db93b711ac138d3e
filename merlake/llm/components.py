"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  Each step is a
grouped minimum, which combines before the shuffle, and a join with it, whose hot keys the
adaptive skew join splits; no group is ever held by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, measure


def _stars(edges: DataFrame) -> bool:
    """Whether every node is the larger end of one edge or the smaller end of some, not both."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    each = ends.groupBy("v").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return each.where("up > 1 or up = 1 and n > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges``, two columns of longs.

    The component is the smallest node that can be reached.  Loops and repeated edges do no
    harm, edges with a null end are ignored, and no edges give no rows.
    """
    first, second = (F.col(c) for c in edges.columns[:2])
    # a is the larger end, b the smaller
    state = materialise(edges.where(first != second).select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).distinct(), "edges")
    while measure(state) and not _stars(state):
        both = state.union(state.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("w")).select(F.col("u").alias("x"), F.least("u", "w").alias("m"))
        least = materialise(least, "least")  # with a shuffle of its own on either side, a hub's join can be split
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
        small = large.join(lowest, F.col("a") == F.col("x")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(state, least)
        state = after
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(state.select("b", "b").distinct())
