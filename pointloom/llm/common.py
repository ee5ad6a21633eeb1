"""Shared helpers of the text-pipeline operators: shared storage and Arrow row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import pointloom
from pointloom.plans.storage import materialise, shared_dir

__all__ = ["ROWS_AT_ONCE", "WS", "held_out", "map_rows", "materialise", "read", "shared_dir", "text_or_empty", "without_ids"]

# Functions of this package travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(pointloom)

#: White space of every contract here: the ASCII blank and the five ASCII controls 0x09-0x0D.
WS = r"[\x20\x09-\x0D]+"
#: Ids that are broadcast at most; more are joined by a shuffle.
MOST_IDS = 1_000_000
#: Rows handed to a Python function at once; bounds a worker's memory on ordinary rows.
ROWS_AT_ONCE = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_rows(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict[str, list] | None], types: list[pa.DataType]) -> DataFrame:
    """``mapInArrow`` over slices of at most ``ROWS_AT_ONCE`` rows.

    ``fn`` gets a record batch and returns the output columns, in the order of ``schema``,
    as a dict of lists (or arrays); None means no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = fn(batch.slice(start, ROWS_AT_ONCE))
                if out:
                    names = list(out)
                    yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(out.values(), types, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def held_out(column: str, mod: int, remainder: int) -> F.Column:
    """True where crc32 of the id as text leaves ``remainder``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % mod == remainder


def without_ids(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id (null is an id too) is not in the one column of ``gone``.

    ``gone`` is written and counted: up to ``MOST_IDS`` ids are broadcast and the texts stay where they are.
    """
    ids = materialise(gone.toDF("__loom_gone").distinct(), name)
    few = ids.count() <= MOST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("__loom_gone")), "left_anti")
