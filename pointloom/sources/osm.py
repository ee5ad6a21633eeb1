"""OpenStreetMap nodes as points: XML through Spark's XML source, PBF through a decoder in ``pbf``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.sources import pbf
from pointloom.sources.points import label_of

NODE_SCHEMA = "_id long, _lat double, _lon double"


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Points (x = latitude, y = longitude) of the ``node`` elements; splits of one file read in parallel."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema(NODE_SCHEMA).load(path)
    return _points(nodes.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")))


def read_pbf(spark: SparkSession, path: str) -> DataFrame:
    """Points of the nodes of PBF files."""
    return _points(pbf.nodes(spark, path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """By extension, as either format."""
    return read_pbf(spark, path) if path.rstrip("/").endswith(".pbf") else read_xml(spark, path)


def _points(nodes: DataFrame) -> DataFrame:
    sound = nodes.filter("id is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    return sound.select("id", label_of(F.col("id")).alias("name"), F.col("lat").alias("x"), F.col("lon").alias("y"))
