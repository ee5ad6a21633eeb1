"""Point tables: schema, validation, labels, page layout, storage.

A point table has ``id`` (long), ``name`` (string) and the coordinates, ``x`` and ``y`` (double) or a list
of further columns.  Coordinates are never NULL or NaN in a validated table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.plans.storage import number_rows

POINT_SCHEMA = "id long, name string, x double, y double"
#: Records of a 32 KiB data page and bytes kept of a name.
PAGE_RECORDS, NAME_BYTES = 564, 30
#: Labels given to unnamed points.
LABELS = 8


def points(df: DataFrame, id: str | Column, x: str | Column, y: str | Column, name: str | Column | None = None) -> DataFrame:
    """The point table of any table, its coordinates as doubles."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    label = col(name).cast("string") if name is not None else label_of(col(id))
    return df.select(col(id).cast("long").alias("id"), label.alias("name"), col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def label_of(id: Column) -> Column:
    """The deterministic label of an unnamed point: 'name 1' to 'name 8'."""
    return F.concat(F.lit("name "), (F.pmod(id, F.lit(LABELS)) + 1).cast("string"))


def _sound(coordinates: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in coordinates])


def valid(df: DataFrame, coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows whose coordinates are numbers."""
    return df.filter(_sound(coordinates))


def invalid(df: DataFrame, coordinates: Sequence[str] = ("x", "y")) -> DataFrame:
    """Rows that ``valid`` leaves out."""
    return df.filter(~_sound(coordinates))


def stored_name(name: Column) -> Column:
    """A name as a 30-byte field keeps it: the longest prefix of whole characters within the bytes."""
    size = F.transform(F.split(name, ""), lambda c: F.octet_length(c))
    before = F.aggregate(size, F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")), lambda a, x: F.when(a["bytes"] + x <= NAME_BYTES, F.struct((a["bytes"] + x).alias("bytes"), (a["n"] + 1).alias("n"))).otherwise(F.struct(F.lit(NAME_BYTES + 1).alias("bytes"), a["n"].alias("n"))))
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(F.substring(name, F.lit(1), before["n"]))


def page_layout(df: DataFrame, records: int = PAGE_RECORDS) -> DataFrame:
    """``df`` with block_id and record_id, pages filled in order of id."""
    return number_rows(df, ["id"], "__n").withColumn("block_id", F.floor(F.col("__n") / records).cast("long")).withColumn("record_id", F.pmod("__n", F.lit(records)).cast("long")).drop("__n")


def fetch(paged: DataFrame, pointers: DataFrame) -> DataFrame:
    """Records at (block_id, record_id) pointers."""
    return paged.join(pointers.select("block_id", "record_id"), ["block_id", "record_id"])


def page_statistics(paged: DataFrame, records: int = PAGE_RECORDS) -> DataFrame:
    """One row: pages, points, records of the fullest and emptiest page, free places in the pages, the next point id and where its record goes."""
    pages = paged.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.max("record_id").alias("last"), F.max("id").alias("top"))
    whole = pages.agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("points"), F.max("n").alias("fullest"), F.min("n").alias("emptiest"),
        F.coalesce(F.max("top") + 1, F.lit(0)).alias("next_id"), F.max(F.struct("block_id", "last")).alias("end"),
    )
    after = F.coalesce(F.col("end.block_id") * records + F.col("end.last") + 1, F.lit(0).cast("long"))
    return whole.select(
        "pages", "points", "fullest", "emptiest", (F.col("pages") * records - F.col("points")).alias("free"), "next_id",
        F.floor(after / records).cast("long").alias("next_block_id"), F.pmod(after, F.lit(records)).alias("next_record_id"),
    )


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store a point table as Parquet; ``append`` adds points."""
    df.write.mode(mode).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
