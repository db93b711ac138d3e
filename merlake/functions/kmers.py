"""Sliding k-mers and minimizers.

``substr`` walks a string from its start, so cutting k-mers straight out of a long sequence
would take time with the square of its length.  Sequences are cut into ever shorter chunks
that overlap by k - 1 bases, and k-mers are cut from the shortest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encode import LONG_K, is_dna, revcomp, with_code_revcomp

_CHUNKS = (1 << 24, 1 << 15, 1 << 7)


def check_k(k: int) -> int:
    if not 8 <= k <= 255:
        raise ValueError(f"k must be between 8 and 255, not {k}")
    return k


def _chunks(seqs: DataFrame, k: int, keep: list[str], seq_col: str) -> DataFrame:
    """``keep``, __at and __s: overlapping chunks that together have every k-mer once.

    A sequence shorter than k has a null array of chunks, and so no rows.
    """
    check_k(k)
    reach = F.when(F.length("__s") >= k, F.length("__s") - k)
    out = seqs.select(*keep, F.lit(0).cast("long").alias("__at"), F.upper(F.col(seq_col)).alias("__s"))
    for size in _CHUNKS:
        starts = F.sequence(F.lit(0), reach, F.lit(size))
        width = F.lit(size + k - 1)
        cut = F.transform(starts, lambda i: F.struct(i.alias("i"), F.substr(F.col("__s"), i + 1, width).alias("s")))  # noqa: B023
        out = out.select(*keep, "__at", F.explode(cut).alias("__c")).select(*keep, (F.col("__at") + F.col("__c.i")).alias("__at"), F.col("__c.s").alias("__s"))
    return out


def _each(k: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.when(F.length("__s") >= k, F.length("__s") - k))).alias("__i")


def kmers(seqs: DataFrame, k: int, keep: list[str], seq_col: str = "seq") -> DataFrame:
    """``keep``, pos and kmer of every k-mer of each row, as it stands (pos from 0, upper case)."""
    out = _chunks(seqs, k, keep, seq_col).select(*keep, "__at", "__s", _each(k))
    return out.select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), F.substr("__s", F.col("__i") + 1, F.lit(k)).alias("kmer"))


def canonical_kmers(seqs: DataFrame, k: int, keep: list[str], seq_col: str = "seq") -> DataFrame:
    """As ``kmers``, but canonical, and without k-mers that hold other letters than ACGT.

    Both strands are cut from their chunk, whose other strand is made once, as is the test
    whether it has any other letters.
    """
    chunks = _chunks(seqs, k, keep, seq_col).select(*keep, "__at", "__s", revcomp(F.col("__s")).alias("__r"), is_dna(F.col("__s")).alias("__clean"))
    out = chunks.select(*keep, "__at", "__s", "__r", "__clean", _each(k))
    ahead = F.substr("__s", F.col("__i") + 1, F.lit(k))
    back = F.substr("__r", F.length("__s") - k - F.col("__i") + 1, F.lit(k))
    return out.where(F.col("__clean") | is_dna(ahead)).select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), F.least(ahead, back).alias("kmer"))


def canonical_codes(seqs: DataFrame, k: int, keep: list[str], seq_col: str = "seq") -> DataFrame:
    """As ``canonical_kmers`` for k up to 31, with k-mers as longs of ordered codes.

    A chunk's strands are each turned into longs of 31 letters once; a k-mer is cut out of
    one or two of them by shifts, so no string is made for it.
    """
    if check_k(k) > LONG_K:
        raise ValueError(f"codes hold up to {LONG_K} letters")
    chunks = _chunks(seqs, k, keep, seq_col).select(*keep, "__at", "__s", is_dna(F.col("__s")).alias("__clean"))
    n_longs = -(-(_CHUNKS[-1] + k - 1) // LONG_K) + 1
    letters = F.when(F.col("__clean"), F.col("__s")).otherwise(F.regexp_replace("__s", "[^ACGT]", "A"))

    def longs(strand: Column) -> Column:
        digits = F.rpad(F.translate(strand, "ACGT", "0123"), n_longs * LONG_K, "0")
        return F.array(*[F.conv(F.substr(digits, F.lit(LONG_K * j + 1), F.lit(LONG_K)), 4, 10).cast("long") for j in range(n_longs)])

    coded = chunks.select(*keep, "__at", "__s", "__clean", letters.alias("__l"))
    coded = coded.select(*keep, "__at", "__s", "__clean", longs(F.col("__l")).alias("__f"), longs(revcomp(F.col("__l"))).alias("__r"))
    each = coded.select(*keep, "__at", "__s", "__clean", "__f", "__r", _each(k))
    code = F.least(_cut("__f", F.col("__i"), k), _cut("__r", F.length("__s") - k - F.col("__i"), k))
    return each.where(F.col("__clean") | is_dna(F.substr("__s", F.col("__i") + 1, F.lit(k)))).select(*keep, (F.col("__at") + F.col("__i")).alias("pos"), code.alias("kmer"))


def _cut(longs: str, at: Column, k: int) -> Column:
    """The code of the k letters from ``at`` of a strand in longs of 31 letters."""
    shift = lambda how, x, n: F.call_function(how, x, n.cast("int"))
    block, left = F.floor(at / LONG_K).cast("int"), LONG_K - at % LONG_K
    high, low = F.get(longs, block), F.get(longs, block + 1)
    own = high.bitwiseAND(shift("shiftleft", F.lit(1).cast("long"), 2 * left) - 1)
    inside = shift("shiftrightunsigned", own, 2 * (left - k))
    across = shift("shiftleft", own, 2 * (k - left)).bitwiseOR(shift("shiftrightunsigned", low, 2 * (LONG_K - k + left)))
    return F.when(left >= k, inside).otherwise(across)


def with_code_minimizer(rows: DataFrame, code: str, k: int, m: int, name: str) -> DataFrame:
    """``rows`` with the ordered code of ``minimizer`` for k-mers given as longs."""
    if not 1 <= m <= k:
        raise ValueError("m must be between 1 and k")
    both = with_code_revcomp(rows, code, k, "__other")
    pieces = [F.shiftrightunsigned(x, 2 * j).bitwiseAND(F.lit((1 << 2 * m) - 1)) for x in (code, "__other") for j in range(k - m + 1)]
    return both.withColumn(name, F.least(*pieces)).drop("__other")


def minimizer(kmer: Column, k: int, m: int) -> Column:
    """The smallest canonical m-mer of a k-mer of length k."""
    if not 1 <= m <= k:
        raise ValueError("m must be between 1 and k")
    pieces = [F.substr(kmer, F.lit(i), F.lit(m)) for i in range(1, k - m + 2)]
    both = pieces + [F.substr(revcomp(kmer), F.lit(i), F.lit(m)) for i in range(1, k - m + 2)]
    return F.least(*both) if len(both) > 1 else both[0]
