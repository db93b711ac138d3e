"""Sample lists, name lists and registration lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.encode import both_trim
from .sequences import read_sequences


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, sample_id, files) of lines ``ID: file ; file``, in the order of lines."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parts = F.split("value", ":", 2)
    files = F.filter(F.transform(F.split(F.element_at(parts, 2), ";"), both_trim), lambda x: x != "")
    named = lines.select("line", both_trim(F.element_at(parts, 1)).alias("sample_id"), files.alias("files"))
    return named.select((F.row_number().over(Window.orderBy("line")) - 1).cast("int").alias("sample_idx"), "sample_id", "files")


def read_samples(spark: SparkSession, samples: DataFrame) -> DataFrame:
    """(sample_idx, name, seq) of all files of a sample list.

    The list is small (a row a sample) and is collected; the sequences are not.
    """
    listed = samples.collect()
    paths = sorted({f for r in listed for f in r.files})
    owners = [(f, r.sample_idx) for r in listed for f in r.files]
    seqs = read_sequences(spark, paths)
    short = F.regexp_replace(F.regexp_replace(F.col("path"), "^file:/+", "/"), "%20", " ")
    where = spark.createDataFrame(owners, "file string, sample_idx int").withColumn("file", F.regexp_replace("file", "^file:/+", "/"))
    return seqs.withColumn("file", short).join(where, "file").select("sample_idx", "name", "seq")


def read_names(spark: SparkSession, names: str) -> list[str]:
    """``a,b,c``, or ``@file`` with a name a line."""
    if not names.startswith("@"):
        return [x.strip() for x in names.split(",") if x.strip()]
    return [r.value.strip() for r in spark.read.text(names[1:]).collect() if r.value.strip()]


def read_registrations(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of a file with tab-separated columns."""
    return spark.read.csv(path, sep="\t", schema="name string, path string").where("name is not null and path is not null")
