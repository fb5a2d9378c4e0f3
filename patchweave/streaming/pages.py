"""Incremental page ingestion: a folder of page files read as a stream, each batch handed to a stateless page function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def page_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 2) -> DataFrame:
    """New Parquet page files as they arrive; the bound on files a batch is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs ``work`` on every batch and appends to ``target``; a batch replayed after a failure overwrites its own folder."""

    def batch(df: DataFrame, epoch: int) -> None:
        work(df).write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def counts_by_window(stream: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each key in tumbling windows, late rows up to ``late`` included."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))
