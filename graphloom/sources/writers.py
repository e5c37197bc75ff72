"""Sinks: partitioned edge tables, id mappings, descriptions, reports, checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _path(spark, old)
    if not fs.rename(p, _path(spark, new)[0]):
        raise OSError(f"cannot rename {old} to {new}")


def copy(spark: SparkSession, old: str, new: str) -> None:
    """A copy of a file or folder, made by the store's own file systems."""
    (a, source), (b, target) = _path(spark, old), _path(spark, new)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(source, a, target, b, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"cannot copy {old} to {new}")


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, through Spark's file systems."""
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_dataset(edges: DataFrame, nodes: DataFrame | None, relations: DataFrame | None, path: str, description: dict) -> None:
    """Edges partitioned by split and buckets, mappings as CSV, the description as JSON."""
    spark = edges.sparkSession
    parts = [c for c in ("split", "src_part", "dst_part") if c in edges.columns]
    edges.repartition(*parts).sortWithinPartitions("src", "dst").write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/edges")
    if nodes is not None:
        nodes.select("raw", "id").write.mode("overwrite").option("header", False).csv(f"{path}/node_mapping")
    if relations is not None:
        relations.select("raw", "id").write.mode("overwrite").option("header", False).csv(f"{path}/relation_mapping")
    write_text(spark, f"{path}/dataset.json", json.dumps(description))


def write_report(rows: DataFrame, path: str) -> None:
    """A report (scores, labels or metrics) as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


class Checkpointer:
    """Versioned tables of a model: written aside, then renamed into place, so a reader never sees half a checkpoint."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, tables: dict[str, DataFrame], meta: dict) -> str:
        version = meta["epoch"]
        tmp, final = f"{self.path}/_tmp-{version}", f"{self.path}/epoch-{version}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp}/{name}")
        write_text(self.spark, f"{tmp}/meta.json", json.dumps(meta | {"tables": sorted(tables)}))
        if exists(self.spark, final):
            remove(self.spark, final)
        rename(self.spark, tmp, final)
        return final

    def load(self, version: int) -> tuple[dict[str, DataFrame], dict]:
        base = f"{self.path}/epoch-{version}"
        meta = json.loads("\n".join(r["value"] for r in self.spark.read.text(f"{base}/meta.json").collect()))
        return {t: self.spark.read.parquet(f"{base}/{t}") for t in meta["tables"]}, meta


def numbered_export(encoded: DataFrame, path: str) -> None:
    """Encoded nodes in id order."""
    encoded.repartitionByRange(F.col("id")).sortWithinPartitions("id").write.mode("overwrite").parquet(path)
