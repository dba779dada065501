"""A queue of point tables as a stream: files that arrive add to a survey's grid metrics.

Partials add up, so each micro-batch writes its own, once, under its number; a reader merges
them. A batch that is replayed after a failure overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import metrics


def watch(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def accumulate(points: DataFrame, out: str, checkpoint: str, res: float = 1.0, once: bool = True) -> StreamingQuery:
    """Partials of every micro-batch, in out/batch=N."""

    def write(batch: DataFrame, number: int) -> None:
        metrics.grid_partial(batch, res).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, out: str, res: float = 1.0) -> DataFrame:
    """The finished metrics of all that has arrived."""
    return metrics.grid_final(metrics.merge_partials(spark.read.parquet(out).drop("batch")), res)
