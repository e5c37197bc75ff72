"""Session helpers that every other module builds on: package shipping, scratch tables, distributed numbering."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (``spark.checkpoint.dir``); where it is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Spark's setting that removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str, *more: DataFrame, onto: DataFrame | None = None, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``more`` rows of the same columns are written one after another, so that the shuffle files of one are gone before the next. They
    are added to ``onto``, if it is given, a table that this function returned. ``by``: a column whose values have a folder each.
    """
    spark = df.sparkSession
    path = onto._scratch if onto is not None else f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The write's shuffle files go with it: nothing else reads them, and they would stay until the driver collects its garbage.
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for rows in (df, *more):
            rows.write.mode("append").parquet(path, partitionBy=by, compression=codec)
    finally:
        spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame | None, part: str | None = None) -> None:
    """Delete the files of a table that :func:`materialize` wrote and that nothing reads any more; ``part``: of one of its folders (column=value)."""
    path = getattr(df, "_scratch", None)
    if path:
        path = f"{path}/{part}" if part else path
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table's rows, counted before the join, up to which it is sent to every executor.
SMALL_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if it is small, by its count; a larger table is left to a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, order: list[Column], out: str, start: int = 0, keys: dict[str, Column] | None = None) -> DataFrame:
    """Dense global row numbers in the given order without a single-task window.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the running total of the
    partition sizes (one row per partition, so its size is bounded by the partition count, not by the data). :func:`release` deletes
    the table that the result is read from. ``keys`` are made to order the rows, before ``order``, and neither shuffled nor written.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    keys = keys or {}
    keyed = df.repartitionByRange(n, *keys.values(), *order).withColumns(keys).sortWithinPartitions(*keys, *order)
    keyed = keyed.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    keyed = keyed.withColumn("_pos", F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
    kept = materialize(keyed.drop("_mono", *keys), "number")
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))
    rows = kept.join(F.broadcast(shift), "_part").withColumn(out, F.col("_pos") + F.col("_before") + F.lit(start)).drop("_part", "_pos", "_before")
    rows._scratch = kept._scratch
    return rows
