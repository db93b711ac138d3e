"""URL rules by a sort-merge range join, on DataFrame functions only.

A rule names a host and a path prefix.  Its canonical key is the host with its labels
reversed, a slash, and the path, so a rule that fits a page is a prefix of the page's key:
an interval of the sorted keys.  Prefix intervals are nested or apart, so sweeping over the
sorted keys needs no more than a stack of the rules that are open.  The stack has a slot a
nesting level; a rule that starts at a level replaces the last one there, and a slot is
active while its rule is a prefix of the key.  The sweep runs side by side over ranges of
keys, each of which is handed the stack as it stands at its start.

A subdomain's page must also meet the rules of its parent domains, whose paths come right
after their own host, so a page has a key for each domain that it belongs to.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, join_hot, materialise, measure, parts, smallest_hashes


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("/"), path)


def _bounds(keys: DataFrame, n: int, total: int) -> list[bytes]:
    """n - 1 places that cut the sorted keys into similar ranges, from a sample of at most 64 n of ``total``.

    The sample only places the cuts; every key is swept.  Of a sampled key the first 64
    bytes come to the driver.
    """
    starts = keys.select(F.substring(F.encode("key", "UTF-8"), 1, 64).alias("start"))
    sample = sorted(bytes(r.start) for r in smallest_hashes(starts, F.xxhash64("start"), 64 * n, total))
    return sorted({sample[len(sample) * k // n] for k in range(1, n)}) if sample else []


def _with_depth(rules: DataFrame, bounds: list[bytes]) -> DataFrame:
    """The rules with their nesting level from 1: a running count of open intervals.

    An interval opens at its key and closes after every string that the key is a prefix of,
    at the key and a byte that no UTF-8 text has.  The count runs within ranges of keys, on
    top of what the ranges before leave open.
    """
    opens = F.struct(F.encode("key", "UTF-8").alias("pos"), F.lit(1).alias("step"))
    closes = F.struct(F.concat(F.encode("key", "UTF-8"), F.unhex(F.lit("FF"))).alias("pos"), F.lit(-1).alias("step"))
    events = rules.select("*", F.explode(F.array(opens, closes)).alias("e"))
    # an interval may close in a later range than it opens in
    events = events.withColumn("r", bucket_of(F.col("e.pos"), bounds))
    sums = events.groupBy("r").agg(F.sum("e.step").alias("s"))
    before = sums.select("r", (F.sum("s").over(Window.orderBy("r")) - F.col("s")).alias("open"))  # a row a range
    local = events.withColumn("run", F.sum("e.step").over(Window.partitionBy("r").orderBy("e.pos", "e.step").rowsBetween(Window.unboundedPreceding, 0)))
    return local.where("e.step = 1").join(F.broadcast(before), "r").withColumn("depth", (F.col("run") + F.col("open")).cast("int")).drop("e", "run", "open", "r")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules`` has the columns host, path and verdict.  A rule fits its host and all its
    subdomains, where the url's path starts with the rule's.  Of the rules that fit, the one
    longest in all characters wins, then the one with the longer host; of repeated rules, the
    alphabetically first verdict.  Without a rule, rule is null and the verdict ``default``.

    A null url, or one without ``://``, has an empty host and path.  Rules with nulls fit
    nothing.  Repeated pages each get the answer, null ids stay null, other columns are
    ignored, and an empty table of pages gives no rows.
    """
    spark = pages.sparkSession
    n = parts(spark)
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    lower = F.translate("host", string.ascii_uppercase, string.ascii_lowercase)
    clean = rules.where("host is not null and path is not null and verdict is not null").select(lower.alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    clean = clean.groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("rule_verdict"))
    labels = F.split("rule_host", r"\.")
    most = clean.agg(F.max(F.size(labels))).first()[0]
    if most is None:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = clean.withColumn("key", _key(_labels(F.col("rule_host")), F.col("rule_path")))

    # equal places are judged once; domains with more labels than any rule's have no rules
    places = materialise(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "places")
    domain = F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(most)))).alias("k")
    points = places.withColumn("labels", _labels(F.col("host"))).select("host", "path", "labels", domain).select("host", "path", _key(F.slice("labels", F.lit(1), F.col("k")), F.col("path")).alias("key"))
    # and each key is swept once, however many places have it
    keys = materialise(points.groupBy("key").agg(F.count("*").alias("n")), "keys")

    bounds = _bounds(keyed.select("key").union(keys.select("key")), n, measure(keys))
    range_of = bucket_of(F.encode("key", "UTF-8"), bounds)
    leveled = materialise(_with_depth(keyed.withColumn("range", range_of), bounds).withColumn("rule", F.concat("rule_host", "rule_path")), "rules", depth=F.max("depth"))
    depth = measure(leveled, "depth")

    # the stack at the start of each range: at each level the last rule that began before
    opened = F.struct(F.col("key").alias("k"), F.col("rule"), F.col("rule_verdict").alias("verdict"), F.length("rule_host").alias("host_length"))
    last = leveled.groupBy("range", "depth").agg(F.max_by(opened, "key").alias("open"))
    grid = spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("range"), F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("depth"))
    past = Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(last, ["range", "depth"], "left")
    carried = carried.select("range", "depth", F.last("open", ignorenulls=True).over(past).alias("open")).where("open is not null")

    nothing = lambda kind: F.lit(None).cast(kind)
    starts = leveled.select("range", "key", F.lit(1).alias("kind"), "depth", opened.alias("open"))
    events = (
        starts.unionByName(carried.select("range", F.lit("").alias("key"), F.lit(0).alias("kind"), "depth", "open"))
        .withColumn("n", nothing("long"))
        .unionByName(keys.select(range_of.alias("range"), "key", F.lit(2).alias("kind"), nothing("int").alias("depth"), nothing(leveled.select(opened.alias("o")).schema["o"].dataType).alias("open"), "n"))
    )
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = [F.last(F.when(F.col("depth") == d, F.col("open")), ignorenulls=True).over(sweep).alias(f"s{d}") for d in range(1, depth + 1)]
    swept = events.select("key", "kind", "n", *stack).where("kind = 2")
    inner = F.coalesce(*[F.when(F.startswith("key", F.col(f"s{d}.k")), F.col(f"s{d}")) for d in range(depth, 0, -1)])
    fits = materialise(swept.select("key", "n", inner.alias("fit")).where("fit is not null"), "fits")
    met = join_hot(points, fits, ["key"], ["host", "path"]).drop("n")
    best = met.groupBy("host", "path").agg(F.max_by("fit", F.struct(F.length("fit.rule"), F.col("fit.host_length"))).alias("fit"))
    best = best.join(places.withColumnsRenamed({"host": "h", "path": "p"}), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
    best = materialise(best.select("host", "path", "fit.rule", F.col("fit.verdict").alias("v"), "n"), "best")
    joined = join_hot(rows, best, ["host", "path"], ["page_id"], "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
