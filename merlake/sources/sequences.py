"""FASTA and FASTQ, plain, gzip or bzip2, from files, strings and literal sequences."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encode import both_trim

EXTENSIONS = ("fa", "fasta", "fna", "fq", "fastq")
_FASTQ = re.compile(r"\.(fq|fastq)(\.(gz|bz2))?$", re.IGNORECASE)
_KNOWN = re.compile(rf"\.({'|'.join(EXTENSIONS)})(\.(gz|bz2))?$", re.IGNORECASE)


def is_sequence_file(path: str) -> bool:
    return bool(_KNOWN.search(path))


def _records(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """FASTA blocks (``value``: a record, its ``>`` perhaps gone) as name and seq."""
    text = F.regexp_replace(F.regexp_replace("value", "^\\s*>", ""), "\r", "")
    lines = F.split(text, "\n", 2)
    named = blocks.where(F.trim(F.regexp_replace("value", r"[>\s]", "")) != "").select(*keep, lines.alias("l"))
    header = F.element_at("l", 1)
    return named.select(*keep, F.element_at(F.split(both_trim(header), r"\s+"), 1).alias("name"), F.upper(F.regexp_replace(F.coalesce(F.try_element_at("l", F.lit(2)), F.lit("")), r"\s", "")).alias("seq"))


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, seq) of every record; the files are split at record starts."""
    blocks = spark.read.text(paths, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("path"))
    return _records(blocks, ["path"])


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, seq) of every record of four lines; qualities are ignored.

    Files are split between lines.  What a line is, its number in the file tells: the lines
    of each split are counted first, and the counts (a row a split) say where it begins.
    """
    read = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("m"))
    splits = read.groupBy("path", "start").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select(F.col("path").alias("p"), F.col("start").alias("s"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    lines = read.join(begins, (F.col("path") == F.col("p")) & (F.col("start") == F.col("s"))).select("path", "value", (F.col("m") - F.col("first") + F.col("before")).alias("line"))
    kind = F.col("line") % 4
    own = lines.where(kind < 2).groupBy("path", F.floor(F.col("line") / 4).alias("record"))
    text = lambda k: F.max(F.when(kind == k, F.regexp_replace("value", "\r$", "")))
    records = own.agg(text(0).alias("head"), text(1).alias("seq")).where("startswith(head, '@') and seq is not null")
    return records.select("path", F.element_at(F.split(F.substr("head", F.lit(2)), r"\s+"), 1).alias("name"), F.upper(both_trim(F.col("seq"))).alias("seq"))


def _fastq(whole: DataFrame, keep: list[str]) -> DataFrame:
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    numbered = whole.select(*keep, lines.alias("l")).select(*keep, "l", F.explode(F.sequence(F.lit(1), F.when(F.size("l") > 3, F.size("l") - 3), F.lit(4))).alias("i"))
    header = F.element_at("l", F.col("i"))
    out = numbered.where(F.size("l") >= 4).where(F.startswith(header, F.lit("@")))
    name = F.element_at(F.split(F.substr(header, F.lit(2)), r"\s+"), 1)
    return out.select(*keep, name.alias("name"), F.upper(both_trim(F.element_at("l", F.col("i") + 1))).alias("seq"))


def read_sequences(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, name, seq) of FASTA and FASTQ files by their extensions; a name with neither is FASTA."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    fastq = [p for p in paths if _FASTQ.search(p)]
    fasta = [p for p in paths if not _FASTQ.search(p)]
    parts = ([read_fasta(spark, fasta)] if fasta else []) + ([read_fastq(spark, fastq)] if fastq else [])
    if not parts:
        return spark.createDataFrame([], "path string, name string, seq string")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def parse_payload(spark: SparkSession, payload: str) -> DataFrame:
    """(name, seq) of the records in a FASTA or FASTQ string."""
    if payload.lstrip().startswith("@"):
        whole = spark.createDataFrame([(payload.strip(),)], "value string")
        return _fastq(whole, [])
    blocks = spark.createDataFrame([(payload,)], "value string").select(F.explode(F.split(F.concat(F.lit("\n"), "value"), "\n>")).alias("value"))
    return _records(blocks, [])


def literal_sequences(spark: SparkSession, name: str, seqs: list[str]) -> DataFrame:
    """(name, seq): sequences that make up one logical query."""
    return spark.createDataFrame([(name, s.upper()) for s in seqs], "name string, seq string")


def random_sequence(spark: SparkSession, n: int, seed: int = 0, pieces: int = 1) -> DataFrame:
    """(name, seq): ``pieces`` sequences of n uniform letters each, the same for the same seed."""
    letter = F.element_at(F.array(*[F.lit(x) for x in "ACGT"]), F.pmod(F.xxhash64(F.lit(seed), "piece", "i"), F.lit(4)).cast("int") + 1)
    rows = spark.range(n * pieces).select((F.col("id") / n).cast("long").alias("piece"), (F.col("id") % n).alias("i")).withColumn("c", letter)
    joined = rows.groupBy("piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x.c), "").alias("seq"))
    return joined.select(F.concat(F.lit("random_"), "piece").alias("name"), "seq")


def with_ids(seqs: DataFrame) -> DataFrame:
    """The rows with a unique qid: record names may repeat, so they can't be keys."""
    return seqs.withColumn("qid", F.monotonically_increasing_id())


def numbered(seqs: DataFrame) -> DataFrame:
    """The rows with qid counting from 0, for batches of a fixed size.

    Rows are counted by partition first, so no task holds more than its own.
    """
    own = seqs.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    sizes = own.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__b"))  # a row a partition
    joined = own.withColumn("__q", part).join(before, F.col("__q") == F.col("__p"))
    return joined.withColumn("qid", F.col("__b") + F.col("__m").bitwiseAND((1 << 33) - 1)).drop("__m", "__p", "__q", "__b")
