"""Skylines: the points no other dominates, smaller being better in every dimension.

Of points at equal coordinates the one of smallest id stands for all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import pointloom
from pointloom.functions import geometry as G
from pointloom.plans.storage import materialise

cloudpickle.register_pickle_by_value(pointloom)

#: Strips of x that the two-dimensional form cuts the points into.
STRIPS = 1024
#: Partitions merged into one in each step of the general form.
MERGE = 8
#: Parts that the groups of the general form are merged in, step by step: a large group is no single task's until it is small.
SALTS = (64, 8, 1)


def skyline_2d(points: DataFrame, strips: int = STRIPS, by: Sequence[str] = ()) -> DataFrame:
    """``by``, id, x, y of the skyline in two dimensions, one per group of ``by``, by built-in aggregation only.

    Each x keeps its least y (map-side).  Equal strips of x drop what lies above the least of all strips before (a table of at most
    ``strips`` rows a group).  What is left is dealt by ranges of equal size, so however the points are spread no task
    sorts all of a group, and stays if its y is below the least of all of smaller x.
    """
    by = list(by)
    best = points.groupBy(*by, "x").agg(F.min(F.struct("y", "id")).alias("b")).select(*by, "x", F.col("b.y").alias("y"), F.col("b.id").alias("id"))
    extent = points.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    strip = F.coalesce(F.least(F.floor((F.col("x") - F.col("lo")) / width * strips), F.lit(strips - 1)), F.lit(0)).cast("int")
    cut = best.join(F.broadcast(extent)).select(*by, "x", "y", "id", strip.alias("s"))  # one row
    above = least_before(cut, by, "s", F.min("y"), "above").filter("above is null or y < above").drop("above", "s")
    ranges = materialise(above.repartitionByRange(*by, "x").withColumn("s", F.spark_partition_id()), "skyline-ranges")
    alive = least_before(ranges, by, "s", F.min("y"), "above").filter("above is null or y < above")
    own = F.min("y").over(Window.partitionBy(*by, "s").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    return alive.withColumn("own", own).filter("own is null or y < own").select(*by, "id", "x", "y")


def least_before(rows: DataFrame, by: Sequence[str], part: str, least: F.Column, name: str) -> DataFrame:
    """``rows`` with the least of what the parts before theirs hold, per group; one row per part and group is joined (broadcast where parts alone bound them)."""
    keys = [F.col(c).alias(f"__{c}") for c in (*by, part)]
    minima = rows.groupBy(*by, part).agg(least.alias("__m")).select(*keys, "__m")
    before = F.min("__m").over(Window.partitionBy(*[f"__{c}" for c in by]).orderBy(f"__{part}").rowsBetween(Window.unboundedPreceding, -1))
    table = minima.select(*[f"__{c}" for c in (*by, part)], before.alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, part)]
    return rows.join(table if by else F.broadcast(table), same).drop(*[f"__{c}" for c in (*by, part)])


def _local(d: int):
    """Skyline of one partition: batches are added to the survivors so far."""

    def reduce(points: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((ids, *points.T[::-1], points.sum(axis=1)))
        points, ids = points[order], ids[order]
        alive = np.ones(len(points), bool)
        for i in range(len(points)):
            if alive[i]:  # nothing later can dominate it: sums do not decrease
                later = alive[i + 1 :]
                later &= ~(points[i] <= points[i + 1 :]).all(axis=1)
        return points[alive], ids[alive]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, ids = np.zeros((0, d)), np.zeros(0, np.int64)
        for batch in batches:
            new = np.column_stack([batch.column(i + 1).to_numpy() for i in range(d)]) if batch.num_rows else np.zeros((0, d))
            new_ids = batch.column(0).to_numpy()
            for at in range(0, len(new), 4096):
                points, ids = reduce(np.concatenate([points, new[at : at + 4096]]), np.concatenate([ids, new_ids[at : at + 4096]]))
        if len(ids):
            yield pa.record_batch([pa.array(ids), *(pa.array(points[:, i]) for i in range(d))], names=["id", *(f"c{i}" for i in range(d))])

    return run


def _local_by_group(d: int):
    """As ``_local`` for rows of several groups, the group's name first."""
    reduce = _local(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.RecordBatch] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(names.dictionary) + 1))
            for name, a, b in zip(names.dictionary.to_pylist(), cuts[:-1], cuts[1:]):
                rows = pa.record_batch(batch.columns[1:], names=batch.schema.names[1:]).take(pa.array(order[a:b]))
                held[name] = next(reduce(iter([held[name], rows] if name in held else [rows])))
        for name, rows in held.items():
            yield pa.record_batch([pa.array([name] * rows.num_rows, pa.string()), *rows.columns], names=["g", *rows.schema.names])

    return run


def skyline(points: DataFrame, coordinates: Sequence[str], id: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """``by``, id and coordinates of the skyline in any number of dimensions, one per group of ``by``.

    Partitions reduce to their own skylines (a point is compared with survivors only), which merge
    ``MERGE`` at a time until one is left: the skyline of a union is that of its parts' skylines.
    """
    d = len(coordinates)
    names = [f"c{i}" for i in range(d)]
    # the row order of sums is exact only if equal rows are one: coordinates are made distinct first
    schema = "id long, " + ", ".join(f"{n} double" for n in names)
    if by:
        group = F.to_json(F.struct(*by))
        distinct = points.groupBy(group.alias("g"), *[F.col(c).cast("double").alias(n) for c, n in zip(coordinates, names)]).agg(F.min(F.col(id).cast("long")).alias("id")).select("g", "id", *names)
        out = distinct.mapInArrow(_local_by_group(d), f"g string, {schema}")
        for salts in SALTS:
            out = out.repartition(F.col("g"), F.pmod(F.xxhash64("id"), F.lit(salts))).mapInArrow(_local_by_group(d), f"g string, {schema}")
        told = F.from_json("g", points.select(*by).schema)
        return out.select(*[told[c].alias(c) for c in by], "id", *[F.col(n).alias(c) for n, c in zip(names, coordinates)])
    distinct = points.groupBy(*[F.col(c).cast("double").alias(n) for c, n in zip(coordinates, names)]).agg(F.min(F.col(id).cast("long")).alias("id")).select("id", *names)
    out = distinct.mapInArrow(_local(d), schema)
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // MERGE)
        out = out.repartition(parts).mapInArrow(_local(d), schema)
    return out.select("id", *[F.col(n).alias(c) for n, c in zip(names, coordinates)])


def dominated_by_any(points: DataFrame, others: DataFrame, coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """Points that some row of ``others`` dominates; only the skyline of ``others`` is compared.

    In two dimensions the skyline is a staircase: along x, the last step before a point is the lowest, and it alone decides.
    Points and steps are dealt by ranges of x together; no pair is formed.  In more dimensions points are compared with the whole skyline.
    """
    if len(coordinates) != 2:
        edge = skyline(others, coordinates).select(*[F.col(c).alias(f"__{c}") for c in coordinates])
        return points.join(edge, G.dominates([F.col(f"__{c}") for c in coordinates], [F.col(c) for c in coordinates]), "left_semi")
    x, y = coordinates
    steps = skyline_2d(others.select("id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    sound = points.select(F.struct("*").alias("__row"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    none = F.lit(None).cast(sound.schema["__row"].dataType)
    both = sound.withColumn("__step", F.lit(1)).unionByName(steps.select(none.alias("__row"), F.col("x").alias("__x"), F.col("y").alias("__y"), F.lit(0).alias("__step")))
    # steps stand before points of the same x
    dealt = materialise(both.repartitionByRange("__x", "__step").withColumn("__part", F.spark_partition_id()), "staircase")
    step = F.when(F.col("__step") == 0, F.struct("__y", "__x"))
    told = least_before(dealt, (), "__part", F.min(step), "__above")
    own = F.min(step).over(Window.partitionBy("__part").orderBy("__x", "__step").rowsBetween(Window.unboundedPreceding, 0))
    low = told.withColumn("__low", F.least(own, F.col("__above"))).filter("__step = 1")
    under = (F.col("__low.__y") < F.col("__y")) | (F.col("__low.__y") == F.col("__y")) & (F.col("__low.__x") < F.col("__x"))
    return low.filter(under).select("__row.*")
