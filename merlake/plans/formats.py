"""Output formats of query results.

Scores are the rows of ``operators.query``.  Presence and abundance differ in what a sample
maps to: its ratio, or its class.  The formats keep rows of at least the threshold ratio, but
the matrix and, of abundances, the line formats keep all; vectors have the ratio beside them,
but in abundance lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = ("json", "matrix", "json_vec", "jsonl", "jsonl_vec")
EXTENSIONS = {"json": "json", "json_vec": "json", "jsonl": "jsonl", "jsonl_vec": "jsonl", "matrix": "tsv"}


def known_format(name: str) -> str:
    """The format of that name; unknown names mean json."""
    return name if name in NAMES else "json"


def _value(abundance: bool, vectors: bool, lines: bool) -> Column:
    if not vectors:
        return F.col("class") if abundance else F.col("ratio")
    if abundance and lines:
        return F.struct(F.col("class").alias("C"), F.col("positions").alias("P"))
    if abundance:
        return F.struct(F.col("class").alias("C"), F.col("positions").alias("P"), F.col("ratio").alias("R"))
    return F.struct(F.col("positions").alias("P"), F.col("ratio").alias("R"))


def sample_maps(scores: DataFrame, threshold: float = 0.0, abundance: bool = False, vectors: bool = False, by: tuple[str, ...] = ("index", "qid", "name"), lines: bool = False) -> DataFrame:
    """``by`` and samples, a map of sample to value, of every query; the map may be empty.

    Samples are in alphabetical order.
    """
    keep = F.lit(True) if lines and abundance else F.col("ratio") >= threshold
    entries = F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("sample").alias("key"), _value(abundance, vectors, lines).alias("value")))))
    return scores.groupBy(*by).agg(F.map_from_entries(entries).alias("samples"))


def to_jsonl(scores: DataFrame, threshold: float = 0.0, abundance: bool = False, vectors: bool = False) -> DataFrame:
    """(index, qid, value): one JSON object a query with index, query and samples."""
    maps = sample_maps(scores, threshold, abundance, vectors, lines=True)
    return maps.select("index", "qid", F.to_json(F.struct("index", F.col("name").alias("query"), "samples")).alias("value"))


def to_json(scores: DataFrame, threshold: float = 0.0, abundance: bool = False, vectors: bool = False, by: tuple[str, ...] = ("index",)) -> DataFrame:
    """(*by, value): one JSON object an index, of query names to their samples; ``by`` may add a batch.

    Of queries with one name the last stays.  A document is one value, so this format is for
    results that a reader can hold; larger ones are written as lines.
    """
    maps = sample_maps(scores, threshold, abundance, vectors, (*by, "qid", "name"))
    last = maps.groupBy(*by, "name").agg(F.max_by("samples", "qid").alias("samples"))
    entries = F.array_sort(F.collect_list(F.struct(F.col("name").alias("key"), F.to_json("samples").alias("value"))))
    members = F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e.key), F.lit(":"), e.value)), ",")
    return last.groupBy(*by).agg(members.alias("m")).select(*by, F.concat(F.lit("{"), _quoted(F.col("index")), F.lit(":{"), "m", F.lit("}}")).alias("value"))


def _quoted(text: Column) -> Column:
    """A JSON string: the one element of a JSON array without its brackets."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def to_matrix(scores: DataFrame, samples: list[str], abundance: bool = False) -> DataFrame:
    """(qid, row, one column a sample): every query's row, without a threshold; row is index:name."""
    value = F.first("class" if abundance else "ratio")
    wide = scores.groupBy("index", "qid", "name").pivot("sample", list(samples)).agg(value)
    return wide.select("qid", F.concat("index", F.lit(":"), "name").alias("row"), *[F.col(f"`{s}`") for s in samples])


def matrix_lines(scores: DataFrame, samples: list[str], index: str, abundance: bool = False) -> DataFrame:
    """(qid, value): the matrix as tab-separated lines, the header at qid -1."""
    head = scores.sparkSession.createDataFrame([(-1, "\t".join([index, *samples]))], "qid long, value string")
    wide = to_matrix(scores, samples, abundance)
    return head.unionByName(wide.select("qid", F.concat_ws("\t", "row", *[F.col(f"`{s}`").cast("string") for s in samples]).alias("value")))


def summary_jsonl(counts: DataFrame, index: str) -> DataFrame:
    """(qid, value): one JSON object a query with the sample count of each k-mer."""
    return counts.select("qid", F.to_json(F.struct(F.lit(index).alias("index"), F.col("name").alias("query"), F.col("counts").alias("abs"))).alias("value"))


def write_results(scores: DataFrame, path: str, form: str, samples: dict[str, list[str]] | None = None, threshold: float = 0.0, abundance: bool = False, batch_size: int = 0, aggregate: bool = False) -> None:
    """Write results as text files, by index; with ``batch_size``, also by batches of so many queries.

    Batches are runs of qid, which should count from 0.  Files are ranges of qid, so one index's
    results are not one task's work.  ``aggregate`` unites the batches of an index again:
    lines are concatenated (the matrix with one header), and documents merged into one.
    """
    form = known_format(form)
    vectors, spark = form.endswith("_vec"), scores.sparkSession
    batch = F.floor(F.col("qid") / batch_size) if batch_size and not aggregate else F.lit(0).cast("long")
    if form.startswith("jsonl"):
        lines = to_jsonl(scores, threshold, abundance, vectors).withColumn("batch", batch)
    elif form.startswith("json"):
        each = scores.withColumn("batch", batch)
        lines = to_json(each, threshold, abundance, vectors, ("batch", "index")).withColumn("qid", F.lit(0).cast("long"))
    else:
        lines = None
        for name, ids in sorted((samples or {}).items()):
            own = matrix_lines(scores.where(F.col("index") == name), list(ids), name, abundance).withColumn("index", F.lit(name)).withColumn("batch", batch)
            if batch_size and not aggregate:  # a header a batch
                head = {"qid": F.lit(-1).cast("long"), "value": F.lit("\t".join([name, *ids])), "index": F.lit(name)}
                heads = own.where("qid >= 0").select("batch").distinct().withColumns(head)
                own = own.where("qid >= 0").unionByName(heads)
            lines = own if lines is None else lines.unionByName(own)
        if lines is None:
            raise ValueError("the matrix format needs the samples of each index")
    by = ["batch", "index"] if batch_size and not aggregate else ["index"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(tasks, *by, "qid").sortWithinPartitions(*by, "qid").select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)
