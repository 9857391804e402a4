"""Tables in the cluster's shared folder, and numbering of rows that no single task could order.

Range partitions are sampled, so a range exchange that is run twice need not cut rows alike. Whatever
is to be counted by range and then numbered by range is therefore written once and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: For tests on one machine; a cluster names its own shared folder.
LOCAL_FOLDER = "/tmp/tidemark-tables"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        found = f"file://{LOCAL_FOLDER}"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def fresh_folder(spark: SparkSession, what: str) -> str | None:
    """A new shared folder by the name under which tasks open files in it; None if it is not in a file system of theirs."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, what))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        return None
    fs.mkdirs(path)
    return path.toUri().getPath()


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage ends there."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(table: DataFrame, order: list, partitions: int | None = None) -> DataFrame:
    """The rows with ``__part``, the number of the range of ``order`` that each lies in; stored."""
    n = partitions or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(table.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running(table: DataFrame, order: list, sums: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Rows with running sums in a total order: ``sums`` names for each new column the one it adds up.

    Each range is summed on its own; what lies before a range comes from one small row for each range.
    """
    ranged = in_ranges(table, order, partitions)
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(of).alias(f"__{name}") for name, of in sums.items()])
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums])
    joined = ranged.join(F.broadcast(offsets), "__part")
    added = {name: F.sum(of).over(inside) + F.col(f"__{name}") for name, of in sums.items()}
    return joined.withColumns(added).drop("__part", *[f"__{name}" for name in sums])
