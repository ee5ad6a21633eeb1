"""Shared storage and global numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``); a local one where that is unset and there is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back: later plans see one fixed result."""
    path = f"{shared_dir(df.sparkSession)}/pointloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Remove all intermediate tables of this package from the shared folder; results still unread would be lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pointloom")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of ``order`` (a total order), without one task sorting all.

    Rows are dealt by range and sorted inside each partition, written once (range bounds are sampled
    and must not change between uses), and each partition's rows start at the count of those before it.
    The table of counts has one row per partition.
    """
    parts = (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)
    fixed = materialise(parts.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, offset = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = fixed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = counts.select("__part", before.alias("__start"))
    joined = fixed.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row per partition
    return joined.withColumn(name, F.col("__start") + offset).drop("__at", "__part", "__start")
