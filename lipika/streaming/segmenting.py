"""The segmentation operators on streams: they are stateless, so the same functions apply."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import runs
from ..sources.files import DOCUMENT


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of JSON-lines files, as they arrive."""
    return spark.readStream.schema(DOCUMENT).json(path)


def slot_totals(docs: DataFrame) -> DataFrame:
    """Runs, characters and bytes by slot so far; for output mode complete or update."""
    return runs(docs).groupBy("slot").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


def write_runs(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append runs to one folder per slot; exactly once by the checkpoint."""
    return runs(docs).writeStream.partitionBy("slot").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs of each micro-batch to a writer of one's own."""
    return runs(docs).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
