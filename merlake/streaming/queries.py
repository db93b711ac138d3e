"""Queries over a stream of sequence files: micro-batches of an append-only source.

A micro-batch is scored by the same plan as a batch query.  The window over a query's
positions is not a window over time, so it runs inside each micro-batch; a record is whole
within one, so no state is kept and no watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.query import query
from ..sources.sequences import _records, with_ids


def stream_sequences(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """(name, seq) of the FASTA files that arrive in a folder."""
    return _records(spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder), [])


def stream_query(index: Index, seqs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, z: int = 0, threshold: float = 0.0, once: bool = False) -> StreamingQuery:
    """Score every micro-batch of (name, seq) and hand it to ``sink`` with the batch's number.

    A batch may be run again after a failure, with the same number; a sink that overwrites by
    number sees each batch once.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(query(index, with_ids(batch), z, threshold).withColumn("batch", F.lit(number)), number)

    writer = seqs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink with a folder a batch; a batch that is run again replaces its own."""
    return lambda scores, number: scores.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={number}")
