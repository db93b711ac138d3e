"""Building k-mer indexes.

An index relates k-mers to samples: a row for each (k-mer, sample) that occurs, so absence
costs nothing.  The exact form is keyed by the canonical k-mer, a long up to 31 bases and a
string beyond; the Bloom form by a cell, the hash of the k-mer within the partition of its
minimizer.  Stored indexes are Parquet, partitioned by ``part`` and sorted by key, so that a
lookup prunes by partition and skips by the key's statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encode import LONG_K, abundance_class, word_of
from ..functions.hashing import HASHES, cell, partition_of
from ..functions.kmers import canonical_codes, canonical_kmers, check_k, minimizer, with_code_minimizer
from . import packed

ENGINE_VERSION = "0.2.0"
#: Rows of a stored index that one file should have, and of a partition's file at most a few times as many.
FILE_ROWS = 4_000_000


@dataclass(frozen=True)
class IndexParams:
    """Everything on which two indexes must agree to be merged or queried together.

    ``bits`` is the width of an abundance class, 1 for presence.  ``window`` is the number of
    cells of a partition and 0 in an exact index.
    """

    k: int
    m: int = 10
    partitions: int = 4
    window: int = 0
    bits: int = 1
    hash: str = "xxhash64"

    def __post_init__(self) -> None:
        check_k(self.k)
        if not 1 <= self.m <= self.k:
            raise ValueError("m must be between 1 and k")
        if self.hash not in HASHES:
            raise ValueError(f"unknown hash {self.hash!r}; known: {', '.join(HASHES)}")
        if self.partitions < 1 or self.window < 0 or not 1 <= self.bits <= 8:
            raise ValueError("partitions must be positive, window at least 0, bits 1 to 8")

    @property
    def exact(self) -> bool:
        return self.window == 0

    @property
    def key(self) -> list[str]:
        return ["part", "kmer"] if self.exact else ["part", "cell"]


@dataclass(frozen=True)
class Index:
    """Rows (part, kmer or cell, sample_idx, cls) and the samples' ids in the order of sample_idx.

    ``order`` says what the tasks of the rows are: "sorted" if each has about a file's rows,
    sorted by part, key and sample; "split" if they only aren't sorted; else "".
    """

    params: IndexParams
    samples: tuple[str, ...]
    rows: DataFrame
    order: str = ""

    def with_rows(self, rows: DataFrame, order: str = "") -> Index:
        return replace(self, rows=rows, order=order)


def bloom_window(bloom_size: int, partitions: int) -> int:
    """The cells of a partition for a filter of ``bloom_size`` cells in all."""
    return max(1, bloom_size // partitions)


def words(seqs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep``, pos and kmer of the canonical k-mers, as longs where they fit."""
    return canonical_codes(seqs, k, keep) if k <= LONG_K else canonical_kmers(seqs, k, keep)


def count_kmers(seqs: DataFrame, k: int, hard_min: int = 1) -> DataFrame:
    """(sample_idx, kmer, n): occurrences of canonical k-mers, those below ``hard_min`` left out.

    Counted before the one shuffle, whose key is the k-mer itself: a frequent one is a row a
    task there, and no minimizer that many k-mers share gathers them in one task.
    """
    counted = words(seqs, k, ["sample_idx"]).groupBy("sample_idx", "kmer").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= hard_min) if hard_min > 1 else counted


def with_key(rows: DataFrame, params: IndexParams) -> DataFrame:
    """``rows`` with the key columns of their kmer, as ``words`` gives it, instead of kmer.

    They can't be null, which spares Spark a test of the hash on every k-mer before it joins.
    """
    sure = lambda c: F.coalesce(c, F.lit(0))
    k, m, coded, kmer = params.k, params.m, params.k <= LONG_K, F.col("kmer")
    rest = [c for c in rows.columns if c != "kmer"]
    if params.partitions == 1:
        out = rows.withColumn("part", F.lit(0))
    else:
        out = with_code_minimizer(rows, "kmer", k, m, "__least") if coded else rows.withColumn("__least", minimizer(kmer, k, m))
        least = word_of(F.col("__least"), m) if coded and params.hash == "md5" else F.col("__least")
        out = out.withColumn("part", sure(partition_of(least, params.partitions, params.hash)))
    if params.exact:
        return out.select("part", (sure(kmer) if coded else kmer).alias("kmer"), *rest)
    whole = kmer if params.hash == "xxhash64" or not coded else word_of(kmer, k)
    return out.select("part", sure(cell(whole, params.window, params.hash, k)).alias("cell"), *rest)


def build(seqs: DataFrame, samples: list[str], params: IndexParams, hard_min: int = 1) -> Index:
    """Index the sequences (sample_idx, seq) of ``samples``.

    In the Bloom form, k-mers of a sample that meet in a cell leave it the highest class.
    K-mers that fit a long with their sample and partition are counted in whole columns
    (``packed``), unless cells need the counts of their k-mers or the hash is ``xxh64``.
    """
    whole = params.exact or (params.hash != "xxh64" and params.bits == 1 and hard_min == 1)
    if params.k <= LONG_K and whole and packed.fits(params.k, len(samples), params.window, params.partitions):
        return Index(params, tuple(samples), packed.build_rows(seqs, len(samples), params, hard_min), "sorted")
    keyed = with_key(count_kmers(seqs, params.k, hard_min), params)
    if not params.exact:
        keyed = keyed.groupBy(*params.key, "sample_idx").agg(F.max("n").alias("n"))
    cls = abundance_class(F.col("n"), params.bits).cast("byte")
    return Index(params, tuple(samples), keyed.select(*params.key, F.col("sample_idx").cast("int").alias("sample_idx"), cls.alias("cls")))


def files_for(rows: int, partitions: int) -> int:
    """Files a partition so that one has about ``FILE_ROWS`` rows."""
    return max(1, -(-rows // (FILE_ROWS * partitions)))


@contextmanager
def _open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Spark sorts what it writes by partition unless that many files can be open at a time."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write(index: Index, path: str, files_per_partition: int | None = None, codec: str = "snappy", level: int | None = None, block_mb: int = 128) -> None:
    """Store the rows by partition, sorted by key.

    Partitions are split over ``files_per_partition`` files by key, so one with many k-mers
    is not one task's work.  Without that number there are as many as the rows need, which
    are counted from a first, unsorted copy beside ``path``, and at least one for each core;
    rows whose tasks are files already (``Index.order``) are neither copied nor shuffled.
    Keys are stored as differences.
    """
    key = index.params.key[1]
    spark = index.rows.sparkSession
    first = None
    stored = lambda rows: rows.write.partitionBy("part").option("compression", codec).option("parquet.block.size", block_mb << 20).option("parquet.writer.version", "v2")
    if files_per_partition is None and index.order:
        rows = index.rows if index.order == "sorted" else index.rows.sortWithinPartitions("part", key, "sample_idx")
        writer = stored(rows)
        if level is not None:
            writer = writer.option("parquet.compression.codec.zstd.level", level)
        with _open_writers(spark, index.params.partitions):
            writer.mode("overwrite").parquet(path)
        return
    if files_per_partition is None:
        first = f"{path.rstrip('/')}-unsorted"
        index.rows.write.mode("overwrite").parquet(first)
        index = index.with_rows(spark.read.schema(index.rows.schema).parquet(first))
        least = -(-spark.sparkContext.defaultParallelism // index.params.partitions)
        files_per_partition = max(least, files_for(index.rows.count(), index.params.partitions))
    dealt = index.rows.repartition(index.params.partitions * files_per_partition, F.col("part"), F.pmod(F.xxhash64(key), F.lit(files_per_partition)))
    writer = stored(dealt.sortWithinPartitions("part", key, "sample_idx"))
    if level is not None:
        writer = writer.option("parquet.compression.codec.zstd.level", level)
    writer.mode("overwrite").parquet(path)
    if first:
        at = spark._jvm.org.apache.hadoop.fs.Path(first)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def to_masks(index: Index) -> DataFrame:
    """The dense form of a presence index: a row a key with the samples' bits in longs of 63.

    (part, key, word, mask): sample_idx = 63 * word + bit.
    """
    word, bit = F.floor(F.col("sample_idx") / 63).cast("int"), (F.col("sample_idx") % 63).cast("int")
    return index.rows.groupBy(*index.params.key, word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("mask"))


def from_masks(masks: DataFrame, params: IndexParams) -> DataFrame:
    """The rows of a presence index from its masks."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.getbit(F.col("mask"), b) == 1)
    each = masks.select(*params.key, "word", F.explode(bits).alias("b"))
    return each.select(*params.key, (F.col("word") * 63 + F.col("b")).cast("int").alias("sample_idx"), F.lit(1).cast("byte").alias("cls"))


def pack_classes(index: Index) -> DataFrame:
    """The dense form of an abundance index: (key, word, packed), 60 // bits samples a long."""
    each = 60 // index.params.bits
    word, place = F.floor(F.col("sample_idx") / each).cast("int"), ((F.col("sample_idx") % each) * index.params.bits).cast("int")
    return index.rows.groupBy(*index.params.key, word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.col("cls").cast("long"), place)).alias("packed"))


def false_positive_rates(index: Index) -> DataFrame:
    """(sample_idx, part, cells, rate): the share of a partition's cells that a sample fills."""
    filled = index.rows.groupBy("sample_idx", "part").agg(F.count("*").alias("cells"))
    return filled.withColumn("rate", F.col("cells") / F.lit(float(max(1, index.params.window))))
