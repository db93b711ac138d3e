"""Queries: which share of a sequence's k-mers occurs in each sample.

With a window of z, words of s + z bases are looked up through their z + 1 words of length
s, which are what the index holds: a word counts for a sample if all of them are there.
Only hits are rows; the window runs over the hits of a (query, sample), where z + 1 hits
within z positions mean that none is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed
from .index import Index, IndexParams, with_key, words


def check_z(z: int) -> int:
    if not 0 <= z <= 8:
        raise ValueError(f"z must be between 0 and 8, not {z}")
    return z


def check_ratio(r: float) -> float:
    if not 0 <= r <= 1:
        raise ValueError(f"the ratio must be between 0 and 1, not {r}")
    return r


def long_enough(seqs: DataFrame, k: int, z: int, least_z: int | None = None) -> DataFrame:
    """The sequences with at least one word of k + z bases."""
    return seqs.where(F.length("seq") >= k + (z if least_z is None else least_z))


def word_count(k: int, z: int) -> Column:
    """How many words of k + z bases a sequence has."""
    return (F.length("seq") - k + 1 - z).cast("long")


def prepare(seqs: DataFrame, params: IndexParams, z: int) -> DataFrame:
    """(qid, pos, key..) of the k-mers to look up.  K-mers with other letters than ACGT never match."""
    own = words(long_enough(seqs, params.k, z), params.k, ["qid"])
    return with_key(own, params)


def lookup(index: Index, asked: DataFrame) -> DataFrame:
    """(qid, sample_idx, pos, cls) of every word in every sample that has it.

    An equality join.  Words that ``query`` knows to be few are sent to the index, which is
    then only scanned; others meet it in blocks of whole columns (``packed.hits_of``) or, where
    keys are no longs, here, both sides shuffled by key.  The partition prunes stored indexes.
    """
    return asked.join(index.rows, index.params.key).select("qid", "sample_idx", "pos", "cls")


#: Letters of all queries together up to which their words are sent to every task that scans the index.
FEW = 1 << 18

#: Positions of a query that one window takes; a longer query is cut into such blocks.
BLOCK = 1 << 14


def window_hits(hits: DataFrame, z: int, blocks: bool = True) -> DataFrame:
    """(qid, sample_idx, pos, cls): the words of k + z bases, with the least class of their parts.

    A window runs over a block of positions.  Hits at the first z positions of a block are
    also given to the block before, where they only end words that begin there.  Without
    ``blocks`` no position is beyond the first.
    """
    check_z(z)
    if z == 0:
        return hits
    own = F.floor(F.col("pos") / BLOCK)
    both = F.when((F.col("pos") % BLOCK < z) & (F.col("pos") >= BLOCK), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = hits.select("qid", "sample_idx", "pos", "cls", F.explode(both).alias("block")) if blocks else hits.withColumn("block", F.lit(0).cast("long"))
    ahead = Window.partitionBy("qid", "sample_idx", "block").orderBy("pos").rangeBetween(0, z)
    wide = dealt.select("qid", "sample_idx", "block", "pos", F.min("cls").over(ahead).alias("cls"), F.count("*").over(ahead).alias("n"))
    return wide.where((F.col("n") == z + 1) & (own == F.col("block"))).select("qid", "sample_idx", "pos", "cls")


def score(hits: DataFrame, seqs: DataFrame, index: Index, z: int, positions: bool = False, threshold: float | None = None) -> DataFrame:
    """(qid, name, sample, nbk, count, ratio, class[, positions]) of each query and sample.

    Samples without hits are there too, with zeros, unless ``threshold`` is above 0: then
    only rows of at least that ratio are, and the zeros aren't even made.  class is the floor
    of the mean class over all words; in a presence index it is the count's own.  positions
    has the class of each word.
    """
    aggregates = [F.count("*").alias("count"), F.sum("cls").alias("total")]
    if positions:
        aggregates.append(F.array_sort(F.collect_list(F.struct("pos", F.col("cls").cast("int").alias("cls")))).alias("found"))
    found = hits.groupBy("qid", "sample_idx").agg(*aggregates).withColumnsRenamed({"qid": "q", "sample_idx": "i"})
    ids = found.sparkSession.createDataFrame(list(enumerate(index.samples)), "sample_idx int, sample string")  # a row a sample
    asked = long_enough(seqs, index.params.k, z).select("qid", "name", word_count(index.params.k, z).alias("nbk"))
    if threshold:
        joined = asked.join(found, F.col("qid") == F.col("q")).join(F.broadcast(ids), F.col("i") == F.col("sample_idx"))
    else:
        # a row for each query and sample is the result itself; all rows of ids meet all queries
        each = asked.crossJoin(F.broadcast(ids))
        joined = each.join(found, (F.col("qid") == F.col("q")) & (F.col("sample_idx") == F.col("i")), "left")
    count = F.coalesce("count", F.lit(0)).cast("long")
    out = joined.select("qid", "name", "sample_idx", "sample", "nbk", count.alias("count"), (count / F.col("nbk")).alias("ratio"), F.floor(F.coalesce("total", F.lit(0)) / F.col("nbk")).cast("int").alias("class"), *([dense_positions(F.col("found"), F.col("nbk")).alias("positions")] if positions else []))
    return out.where(F.col("ratio") >= threshold) if threshold else out


def dense_positions(found: Column, n: Column) -> Column:
    """An array of n classes from sorted (pos, cls) structs, 0 where there is none."""
    shifted = F.concat(F.array(F.lit(-1).cast("long")), F.transform(found, lambda x: x.pos))
    filled = F.flatten(F.zip_with(found, F.slice(shifted, F.lit(1), F.size(found)), lambda x, before: F.concat(F.array_repeat(F.lit(0), (x.pos - before - 1).cast("int")), F.array(x.cls))))
    tail = F.array_repeat(F.lit(0), (n - 1 - F.element_at(found, -1).pos).cast("int"))
    return F.when(found.isNull(), F.array_repeat(F.lit(0), n.cast("int"))).otherwise(F.concat(filled, tail))


def query(index: Index, seqs: DataFrame, z: int = 0, threshold: float = 0.0, positions: bool = False) -> DataFrame:
    """Score the sequences (qid, name, seq) against all samples of an index."""
    check_ratio(threshold)
    asked = prepare(seqs, index.params, z)
    letters, longest = (x or 0 for x in seqs.agg(F.sum(F.length("seq")), F.max(F.length("seq"))).first())
    few = letters <= FEW
    if not few and packed.answers(index):
        found = packed.hits_of(index, long_enough(seqs, index.params.k, z))
    else:
        found = lookup(index, F.broadcast(asked) if few else asked)
    hits = window_hits(found, z, longest > BLOCK)
    return score(hits, seqs, index, z, positions, threshold)


def query_many(indexes: dict[str, Index], seqs: DataFrame, z: int = 0, threshold: float = 0.0, positions: bool = False) -> DataFrame:
    """As ``query`` over several indexes, with the index's name in the column index."""
    if not indexes:
        raise ValueError("no index to query")
    out = None
    for name, index in indexes.items():
        own = query(index, seqs, z, threshold, positions).withColumn("index", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def merge_records(scores: DataFrame, by: list[str], abundance: bool = False, positions: bool = False) -> DataFrame:
    """One row for each group of records and each sample.

    Presence: the sum of the counts over the sum of the words.  Abundance: the floor of the
    mean class and the plain mean of the ratios.  positions is the list of the records' own,
    in the order of qid.
    """
    key = [*by, "sample_idx", "sample"]
    ratio = F.avg("ratio") if abundance else F.sum("count") / F.sum("nbk")
    out = [F.count("*").alias("records"), F.sum("nbk").alias("nbk"), F.sum("count").alias("count"), ratio.alias("ratio"), F.floor(F.sum("class") / F.count("*")).cast("int").alias("class")]
    if positions:
        out.append(F.transform(F.array_sort(F.collect_list(F.struct("qid", "positions"))), lambda x: x.positions).alias("positions"))
    return scores.groupBy(*key).agg(*out)
