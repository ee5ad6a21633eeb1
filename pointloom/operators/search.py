"""Range, lookup and nearest-neighbour queries on point tables, single and batched, without an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.plans.storage import number_rows

#: Cells per dimension of the grid that batched range queries join on.
GRID = 64


def range_query(points: DataFrame, area: Sequence[Sequence[float]], coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points inside the closed rectangle [[low, high], ...]; the comparisons reach the scan."""
    low, high = zip(*area)
    return points.filter(G.contains(low, high, [F.col(c) for c in coordinates]))


def lookup(points: DataFrame, id: int) -> DataFrame:
    """The point of an id: at most one row, the least by coordinates and name if ids repeat."""
    return points.filter(F.col("id") == id).orderBy(*[c for c in points.columns if c != "id"]).limit(1)


def exact_match(points: DataFrame, at: Sequence[float], coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points at exactly these coordinates."""
    return points.filter(G.equal([F.col(c) for c in coordinates], at))


def knn(points: DataFrame, at: Sequence[float], k: int, coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """The k nearest points with ``dist``, by distance, then id (a top-k per task, then one of those)."""
    return points.withColumn("dist", G.distance([F.col(c) for c in coordinates], at)).orderBy("dist", "id").limit(k)


def knn_vectors(points: DataFrame, column: str, at: Sequence[float], k: int, id: str = "id") -> DataFrame:
    """As ``knn`` for points whose coordinates are an array column; vectors of another length are left out."""
    pairs = F.zip_with(F.col(column).cast("array<double>"), F.array(*[F.lit(float(v)) for v in at]), lambda a, b: (a - b) * (a - b))
    square = F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)
    fits = points.filter(F.size(column) == len(at))
    return fits.withColumn("dist", F.sqrt(square)).orderBy("dist", id).limit(k)


def mindist_to_origin(rectangles: DataFrame, low: Sequence[str] = ("x_min", "y_min"), high: Sequence[str] = ("x_max", "y_max")) -> DataFrame:
    """``rectangles`` with ``mindist``, their distance to the origin."""
    return rectangles.withColumn("mindist", G.mindist([F.col(c) for c in low], [F.col(c) for c in high], [0.0] * len(low)))


def by_mindist(rectangles: DataFrame, at: Sequence[float], id: str = "node_id", low: Sequence[str] = ("x_min", "y_min"), high: Sequence[str] = ("x_max", "y_max")) -> DataFrame:
    """``rectangles`` with ``mindist`` to a point and their place in its order (from 0; equal distances by id), without one task sorting all."""
    near = rectangles.withColumn("mindist", G.mindist([F.col(c) for c in low], [F.col(c) for c in high], at))
    return number_rows(near, ["mindist", id], "place")


def borders(rows: DataFrame, values: Sequence[F.Column], grid: int = GRID) -> list[list[float]]:
    """Inner borders of at most ``grid`` cells of equal content for each value, by one aggregation (``grid`` numbers a value)."""
    shares = [i / grid for i in range(1, grid)]
    got = rows.agg(*[F.percentile_approx(v, shares, 20 * grid).alias(f"b{i}") for i, v in enumerate(values)]).first()
    return [sorted(set(b or [])) for b in got]


def cell(value: F.Column, inner: Sequence[float]) -> F.Column:
    """Number of borders up to ``value``."""
    return F.size(F.filter(F.array(*map(F.lit, inner)), lambda b: b <= value)) if inner else F.lit(0)


def range_join(points: DataFrame, areas: DataFrame, grid: int = GRID) -> DataFrame:
    """Points inside each area (area_id, x_min, x_max, y_min, y_max): area_id with the point's columns.

    A grid turns the rectangle test into an equality: an area lists the cells it
    touches (at most ``grid`` squared), a point lies in one cell, so no pair appears twice.  Borders are quantiles of the
    points in the areas' extent, so clustered points spread over many cells; the others are dropped before the join.
    """
    box = areas.agg(F.min("x_min").alias("x0"), F.max("x_max").alias("x1"), F.min("y_min").alias("y0"), F.max("y_max").alias("y1")).first()
    if box["x0"] is None:
        return points.select(F.lit(None).cast("long").alias("area_id"), "*").limit(0)
    inside = points.filter(G.contains([box["x0"], box["y0"]], [box["x1"], box["y1"]], [F.col("x"), F.col("y")]))
    inner = dict(zip("xy", borders(inside, [F.col("x"), F.col("y")], grid)))
    cells = areas.select("area_id", "x_min", "x_max", "y_min", "y_max").filter("x_min <= x_max and y_min <= y_max")
    celled = inside
    for axis in "xy":
        cells = cells.select("*", F.explode(F.sequence(cell(F.col(f"{axis}_min"), inner[axis]), cell(F.col(f"{axis}_max"), inner[axis]))).alias(f"__c{axis}"))
        celled = celled.withColumn(f"__c{axis}", cell(F.col(axis), inner[axis]))
    joined = celled.join(cells, ["__cx", "__cy"])
    return joined.filter(G.contains([F.col("x_min"), F.col("y_min")], [F.col("x_max"), F.col("y_max")], [F.col("x"), F.col("y")])).select("area_id", *points.columns)


def nearest_per_query(candidates: DataFrame, k: int) -> DataFrame:
    """The k rows of least (dist, id) of each qid, by a window that keeps k rows per task before shuffling."""
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)
