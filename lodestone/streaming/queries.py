"""Compiled queries over streams: a plan is built on streaming DataFrames and written as they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.artifact import Artifact
from lodestone.plans.plan import frame
from lodestone.plans.query import Query


def stream_parquet(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A folder's Parquet files as a stream, with the schema that they have."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def start(
    spark: SparkSession, query: Query | Artifact, tables: dict[str, DataFrame], sink: str, checkpoint: str, mode: str = "append", once: bool = True
) -> StreamingQuery:
    """Run a query over ``tables``, of which some are streams, into Parquet at ``sink`` (append)
    or into a memory table of that name (complete, update). ``once`` takes what is there and ends."""
    writer = frame(spark, query.plan, tables).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.format("parquet").option("path", sink) if mode == "append" else writer.format("memory").queryName(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()
