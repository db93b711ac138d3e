"""Bases, strands, abundance classes and bit operations as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digits(seq: Column) -> Column:
    """Two-bit codes of bases as digits: A 0, C 1, T 2, G 3; case doesn't matter."""
    return F.translate(F.upper(seq), "ACTG", "0123")


#: The longest k-mer that is held in a long.
LONG_K = 31


def packed(kmer: Column) -> Column:
    """A k-mer of up to 31 bases as a long, the first base in the highest bits; null if it is longer."""
    return F.when(F.length(kmer) <= LONG_K, F.conv(digits(kmer), 4, 10).cast("long"))


def word_of(code: Column, k: int) -> Column:
    """The k-mer of a long of ordered codes (A 0, C 1, G 2, T 3), in which order is alphabetical."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def with_code_revcomp(rows: DataFrame, code: str, k: int, name: str) -> DataFrame:
    """``rows`` with the ordered code of the other strand: all bits complemented, and the order
    of the pairs turned round.  Each step is a column of its own, as it is used twice by the next."""
    out = rows.withColumn(name, F.bitwise_not(code))
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x, keep = F.col(name), F.lit(mask)
        out = out.withColumn(name, F.shiftrightunsigned(x, shift).bitwiseAND(keep).bitwiseOR(F.shiftleft(x.bitwiseAND(keep), shift)))
    x = F.col(name)
    return out.withColumn(name, F.shiftrightunsigned(F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32)), 64 - 2 * k))


def revcomp(seq: Column) -> Column:
    """The reverse complement; other letters than ACGT stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The alphabetically smaller of the k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def canonical_packed(kmer: Column) -> Column:
    """The numerically smaller of the two strands' two-bit codes, for up to 31 bases."""
    return F.least(packed(kmer), packed(revcomp(kmer)))


def is_dna(seq: Column) -> Column:
    return ~seq.rlike("[^ACGT]")


def abundance_class(count: Column, bits: int) -> Column:
    """0 for 0, else the count's bit length, at most ``2**bits - 1``."""
    return F.when(count <= 0, 0).otherwise(F.least(F.length(F.bin(count.cast("long"))), F.lit(2**bits - 1))).cast("int")


def bit_of(mask: Column, index: Column) -> Column:
    """The bit of a sample in a row mask."""
    return F.getbit(mask, index)


def unpacked(packed_row: Column, bits: int, samples: int) -> Column:
    """The fields of a packed row, as an array of ``samples`` classes."""
    each = F.sequence(F.lit(0), F.lit(max(0, samples - 1)))
    return F.transform(each, lambda i: field_of(packed_row, i, bits).cast("int")) if samples else F.array().cast("array<int>")


def field_of(packed_row: Column, index: Column, bits: int) -> Column:
    """The ``bits`` wide field of a sample in a packed row."""
    return F.call_function("shiftrightunsigned", packed_row, (index * bits).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))


def corrected(count: Column, n_samples: int, share: float) -> Column:
    """A cell's sample count less the samples expected to be false, at least 0; no share, no change."""
    return count.cast("long") if share <= 0 else F.greatest(F.lit(0), F.round(count - share * n_samples)).cast("long")


def left_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def right_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def both_trim(text: Column) -> Column:
    return right_trim(left_trim(text))
