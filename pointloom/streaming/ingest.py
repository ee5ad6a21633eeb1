"""Continuous append of points: micro-batches validated and added to a point table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pointloom.sources import points as P


def watch(spark: SparkSession, folder: str, schema: str = P.POINT_SCHEMA, format: str = "parquet") -> DataFrame:
    """Point files as they arrive in a folder."""
    return spark.readStream.format(format).schema(schema).load(folder)


def append(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add each micro-batch's valid points to the table at ``path``, exactly once (file sink and its log)."""
    writer = P.valid(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
