"""Insertion and deletion as table transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert(points: DataFrame, new: DataFrame) -> DataFrame:
    """``points`` with the rows of ``new``; ids are not required to differ."""
    return points.unionByName(new.select(*points.columns))


def repeated_ids(points: DataFrame) -> DataFrame:
    """Ids that several points carry, with their number: the optional check of an insertion."""
    return points.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def delete(points: DataFrame, keys: DataFrame) -> DataFrame:
    """``points`` without those whose id and exact coordinates appear in ``keys``."""
    return points.join(keys.select("id", "x", "y").distinct(), ["id", "x", "y"], "left_anti").select(*points.columns)


def deleted(points: DataFrame, keys: DataFrame) -> DataFrame:
    """The points that ``delete`` takes away; its count is the deletion's answer."""
    return points.join(keys.select("id", "x", "y").distinct(), ["id", "x", "y"], "left_semi").select(*points.columns)
