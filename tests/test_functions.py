import random

import pytest
import xxhash
from pyspark.sql import functions as F

from merlake.functions import encode, hashing
from merlake.functions.kmers import canonical_codes, canonical_kmers, kmers, minimizer, with_code_minimizer


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_cells_match_known_values(spark):
    # fixed values: the cells of the eleven 25-mers of a sequence, with 200,000 cells a partition
    seq = "AGCAGATTAAGCATATATATCCGACGATAACACTA"
    cells = [102658, 123165, 161320, 193062, 164937, 169286, 60386, 144980, 49698, 4538, 189458]
    df = spark.createDataFrame([(0, seq)], "qid long, seq string")
    got = kmers(df, 25, ["qid"]).select("pos", hashing.cell(F.col("kmer"), 200_000, "xxh64", 25).alias("cell")).orderBy("pos").collect()
    assert [r.cell for r in got] == cells


def test_kmers_of_long_and_short_sequences(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, 7, 8, 9, 255, 256, 257, 263, 264, 70_000)] + ["acgtnacgtacgtacgt", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "qid long, seq string")
    got = {}
    for r in kmers(df, 8, ["qid"]).collect():
        got[r.qid, r.pos] = r.kmer
    want = {(i, p): s[p : p + 8].upper() for i, s in enumerate(seqs) if s for p in range(len(s) - 7)}
    assert got == want
    clean = {(r.qid, r.pos): r.kmer for r in canonical_kmers(df, 8, ["qid"]).collect()}
    assert clean == {k: min(v, _rc(v)) for k, v in want.items() if set(v) <= set("ACGT")}


def test_minimizer_is_the_least_canonical_piece(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("ACGT") for _ in range(15)) for _ in range(50)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", minimizer(F.col("w"), 15, 6).alias("m"), minimizer(encode.revcomp(F.col("w")), 15, 6).alias("n")).collect():
        assert r.m == r.n == min(x for s in (r.w, _rc(r.w)) for x in (s[i : i + 6] for i in range(10)))


@pytest.mark.parametrize(("k", "m"), [(8, 8), (15, 6), (31, 11)])
def test_codes_are_the_kmers(spark, k, m):
    rng = random.Random(k)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (0, k - 1, k, 127, 128 + k, 500)] + ["acgtn" * 30, "N" * 40, None, "ACGT" * 9 + "x" + "TTGACCA" * 20]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "qid long, seq string")
    want = sorted((r.qid, r.pos, r.kmer, r.m) for r in canonical_kmers(df, k, ["qid"]).select("*", minimizer(F.col("kmer"), k, m).alias("m")).collect())
    coded = with_code_minimizer(canonical_codes(df, k, ["qid"]), "kmer", k, m, "m")
    got = sorted((r.qid, r.pos, r.kmer, r.m) for r in coded.select("qid", "pos", encode.word_of(F.col("kmer"), k).alias("kmer"), encode.word_of(F.col("m"), m).alias("m")).collect())
    assert got == want and got
    with pytest.raises(ValueError):
        canonical_codes(df, 32, ["qid"])


@pytest.mark.parametrize("k", [25, 31, 32, 63, 64, 100, 255])
def test_long_cells(spark, k):
    """XXH64 over the little-endian code of the smaller strand, against the library."""
    rng = random.Random(k)
    words = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(20)]
    code = lambda w: int(w.translate(str.maketrans("ACTG", "0123")), 4)
    want = [xxhash.xxh64_intdigest(min(code(w), code(_rc(w))).to_bytes(80, "little")[: hashing.hashed_bytes(k)]) % 1009 for w in words]
    df = spark.createDataFrame([*enumerate(words), (99, None)], "i int, w string")
    got = {r.i: r.c for r in df.select("i", hashing.cell(F.col("w"), 1009, "xxh64", k).alias("c"), encode.packed(F.col("w")).alias("p")).collect()}
    assert [got[i] for i in range(20)] == want and got[99] is None
    with pytest.raises(ValueError):
        hashing.cell(F.col("w"), 9, "xxh64")


def test_scalars(spark):
    row = spark.createDataFrame([(0, 1, 2, 3, 100, "  a b\t", "ACGTN", 0b1101)], "z long, a long, b long, c long, d long, t string, s string, m long").select(
        *[encode.abundance_class(F.col(c), 2).alias(c) for c in "zabcd"],
        encode.both_trim(F.col("t")).alias("trim"),
        encode.left_trim(F.col("t")).alias("left"),
        encode.right_trim(F.col("t")).alias("right"),
        encode.revcomp(F.col("s")).alias("rc"),
        encode.packed(F.lit("ACTG")).alias("code"),
        encode.bit_of(F.col("m"), F.lit(1)).alias("bit1"),
        encode.bit_of(F.col("m"), F.lit(2)).alias("bit2"),
        encode.field_of(F.col("m"), F.lit(1), 2).alias("field"),
        encode.corrected(F.lit(5), 10, 0.25).alias("corrected"),
        encode.corrected(F.lit(1), 10, 0.25).alias("none_left"),
        encode.corrected(F.lit(5), 10, 0.0).alias("as_is"),
    ).first()
    assert [row[c] for c in "zabcd"] == [0, 1, 2, 2, 3]
    assert (row.trim, row.left, row.right) == ("a b", "a b\t", "  a b")
    assert (row.rc, row.code) == ("NACGT", 0b00011011)
    assert (row.bit1, row.bit2, row.field) == (0, 1, 0b11)
    packed = spark.range(1).select(encode.unpacked(F.lit(0b111001).cast("long"), 2, 4).alias("a"), encode.unpacked(F.lit(1).cast("long"), 2, 0).alias("b")).first()
    assert (list(packed.a), list(packed.b)) == ([1, 2, 3, 0], [])
    assert (row.corrected, row.none_left, row.as_is) == (3, 0, 5)
