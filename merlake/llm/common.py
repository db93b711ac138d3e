"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Characters that the contracts call white space.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only where a local session has none (as in tests) a folder of our own is made, and
    removed when Python ends; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="merlake-", dir=_own_root())
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _own_root() -> str:
    from pathlib import Path

    root = Path("/tmp/checkpoints")
    root.mkdir(parents=True, exist_ok=True)
    return str(root)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, **measures: Column) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that survive the loss of any executor, and makes
    sure that a table which is used twice is computed once.  The aggregates ``measures``, the number
    of rows and, of a column n, the sum and the maximum are taken on the way: ``measure``.
    """
    path = new_path(df.sparkSession, tag)
    seen = Observation()
    if "n" in df.columns:
        measures = {"total": F.sum("n"), "most": F.max("n")} | measures
    df.observe(seen, F.count("*").alias("rows"), *[c.alias(name) for name, c in measures.items()]).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._own_path, out._measures = path, seen.get
    return out


def measure(df: DataFrame, name: str = "rows") -> int:
    """What ``materialise`` has measured of a table that it gave; 0 of an empty one."""
    return df._measures[name] or 0


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` gave, once nothing reads them any more."""
    for df in tables:
        remove(df.sparkSession, df._own_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of less than 64 MB in fewer files than there are cores is dealt over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < 1 << 26 and len(df.inputFiles()) < cores else df


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def smallest_hashes(rows: DataFrame, hashed: Column, need: int, total: int) -> list:
    """The ``need`` rows with the smallest hash, the same in every run; ``total`` is their number.

    A bound on the hash leaves about four times as many as are needed, so that the tasks
    together send little however many they are; should it leave too few, it is dropped.
    """
    own = rows.withColumn("__hash", F.pmod(hashed, F.lit(1 << 32)))
    bound = min(1 << 32, (1 << 34) * need // max(total, 1))
    found = own.where(F.col("__hash") < bound).orderBy(*own.columns[::-1]).limit(need).drop("__hash").collect()
    if len(found) < need and bound < 1 << 32:
        found = own.orderBy(*own.columns[::-1]).limit(need).drop("__hash").collect()
    return found


#: Keys that fewer rows have than this are never split.
HOT_ROWS = 256


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], spread: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """``rows`` joined with ``keyed``, from ``materialise``: a row a key with the number ``n`` of rows that have it.

    Keys that hold more than 1 / ``share`` of all rows, of which there are fewer than
    ``share``, are split: their rows by a hash of the columns ``spread``, and their row of
    ``keyed`` goes to every part.  So no task gets one key's rows, however many they are.
    Both tables name the key's columns alike, and have no other name in common.  A null key
    meets nothing.
    """
    n_salts = parts(rows.sparkSession)
    least = max(HOT_ROWS, measure(keyed, "total") // share)
    hashed = F.xxhash64(*on)
    hot = [r.h for r in keyed.where(F.col("n") > least).select(hashed.alias("h")).collect()] if n_salts > 1 and measure(keyed, "most") > least else []
    other = keyed.withColumnsRenamed({c: f"__{c}" for c in on})
    met = [F.col(c) == F.col(f"__{c}") for c in on]
    if hot:
        zero, last = F.lit(0).cast("long"), F.lit(n_salts - 1).cast("long")
        rows = rows.withColumn("__salt", F.when(hashed.isin(hot), F.pmod(F.xxhash64(*spread, F.lit(7)), F.lit(n_salts))).otherwise(zero))
        copies = F.when(F.xxhash64(*[f"__{c}" for c in on]).isin(hot), F.sequence(zero, last)).otherwise(F.array(zero))
        other = other.withColumn("__copy", F.explode(copies))
        met.append(F.col("__salt") == F.col("__copy"))
    return rows.join(other, met, how).drop("__salt", "__copy", *[f"__{c}" for c in on])


def longs(values: list[int]) -> Column:
    """A literal array of longs, made from one string however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_of(key: Column, bounds: list) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``: the key's range, from 0.

    Searches in two steps, so a row costs about twice the square root of the bounds.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    literal = longs if all(isinstance(b, int) for b in bounds) else lambda xs: F.array(*[F.lit(x) for x in xs])
    coarse = F.size(F.filter(literal(bounds[::step]), lambda x: x <= key))
    fine = F.size(F.filter(F.slice(literal(bounds), (coarse - 1) * step + 1, F.lit(step)), lambda x: x <= key))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)
