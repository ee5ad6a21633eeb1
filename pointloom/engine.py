"""A handle with the calls a user of a tree index expects, over the tables of ``plans.index``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pointloom.operators import search
from pointloom.plans.index import FILL, MOST, PointIndex
from pointloom.sources import osm
from pointloom.sources import points as P


class PointEngine:
    """Points with their index: load, query, change, save.

    Queries return DataFrames (lazy, distributed); changes return a new engine, since tables do not change in
    place.  ``serial_search`` scans without the index.
    """

    def __init__(self, index: PointIndex):
        self.index = index

    @classmethod
    def bulk_loading(cls, points: DataFrame, most: int = MOST, fill: float = FILL) -> PointEngine:
        return cls(PointIndex.build(P.valid(points), most, fill))

    @classmethod
    def from_osm(cls, spark: SparkSession, path: str, most: int = MOST, fill: float = FILL) -> PointEngine:
        """All nodes of an OSM file (XML or PBF)."""
        return cls.bulk_loading(osm.read(spark, path), most, fill)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PointEngine:
        return cls(PointIndex.load(spark, path))

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.index.save(path, mode)

    @property
    def points(self) -> DataFrame:
        return self.index.rows()

    def range_query(self, area: Sequence[Sequence[float]]) -> DataFrame:
        return self.index.range_query(area)

    def knn_query(self, k: int, point: Sequence[float]) -> DataFrame:
        return self.index.knn(point, k)

    def skyline_query(self) -> DataFrame:
        return self.index.skyline()

    def serial_search(self, id: int) -> DataFrame:
        return search.lookup(self.points, id)

    def insert_points(self, new: DataFrame) -> PointEngine:
        return PointEngine(self.index.insert(P.valid(new)))

    def insert_point(self, id: int, coordinates: Sequence[float], name: str | None = None) -> PointEngine:
        spark = self.points.sparkSession
        row = [(id, name if name is not None else f"name {1 + id % P.LABELS}", float(coordinates[0]), float(coordinates[1]))]
        return self.insert_points(spark.createDataFrame(row, P.POINT_SCHEMA))

    def remove_points(self, keys: DataFrame) -> tuple[PointEngine, int]:
        """(the engine without the points at these ids and coordinates, how many went)."""
        index, gone = self.index.delete(keys)
        return PointEngine(index), gone

    def remove_point(self, id: int, coordinates: Sequence[float]) -> tuple[PointEngine, bool]:
        keys = self.points.sparkSession.createDataFrame([(id, float(coordinates[0]), float(coordinates[1]))], "id long, x double, y double")
        engine, gone = self.remove_points(keys)
        return engine, gone > 0

    def statistics(self) -> DataFrame:
        return self.index.level_statistics()

    def meta(self) -> DataFrame:
        return self.index.meta()
