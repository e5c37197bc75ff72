"""Sources: delimited text, raw binary matrices, numpy, partition offsets, dataset descriptions."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import ship

#: Fixed value: numpy types of raw files.
DTYPES = {"INT": "<i4", "INT32": "<i4", "LONG": "<i8", "INT64": "<i8", "FLOAT": "<f4", "FLOAT32": "<f4", "DOUBLE": "<f8", "FLOAT64": "<f8"}


def read_delimited(spark: SparkSession, path: str, columns: tuple[int, ...] = (0, 1, 2), delimiter: str = "\t", header_rows: int = 0, strings: bool = True) -> DataFrame:
    """(src, rel, dst), or (src, dst) for two columns, by position; the first ``header_rows`` lines of each file go.

    With one header row files are read as CSV, quotes included; else lines are split by plain text.
    """
    if len(columns) not in (2, 3):
        raise ValueError("two or three columns are needed")
    if header_rows == 1:
        return _csv(spark, path, columns, delimiter, strings)
    lines = _without_headers(spark, path, header_rows) if header_rows else spark.read.text(path)
    parts = F.split("value", "\\Q" + delimiter + "\\E")
    names = ("src", "rel", "dst") if len(columns) == 3 else ("src", "dst")
    kind = "string" if strings else "long"
    return lines.select(*[F.get(parts, F.lit(c)).cast(kind).alias(n) for c, n in zip(columns, names, strict=True)])


def _csv(spark: SparkSession, path: str, columns: tuple[int, ...], delimiter: str, strings: bool) -> DataFrame:
    names = ("src", "rel", "dst") if len(columns) == 3 else ("src", "dst")
    rows = spark.read.option("header", True).option("sep", delimiter).csv(path)
    kind = "string" if strings else "long"
    return rows.select(*[F.col(f"`{rows.columns[c]}`").cast(kind).alias(n) for c, n in zip(columns, names, strict=True)])


def _without_headers(spark: SparkSession, path: str, header_rows: int) -> DataFrame:
    """(value) of the lines after each file's first ``header_rows``.

    Spark reads a file's split beginning at byte 0 in order, so a header's lines are the first rows of the partition that
    holds that split, as long as they end in it: splits are far longer than headers.
    """
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    out = pa.schema([("value", pa.string())])

    def run(batches):
        seen: dict[str, int] = {}
        for b in batches:
            files, blocks = b.column("file").to_pylist(), b.column("block").to_pylist()
            kept = []
            for i, (file, block) in enumerate(zip(files, blocks, strict=True)):
                n = seen.get(file, 0)
                if block == 0 and n < header_rows:
                    seen[file] = n + 1
                else:
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([b.column("value").take(pa.array(kept, pa.int64()))], schema=out)

    return own.mapInArrow(run, "value string")


def read_matrix(spark: SparkSession, path: str, width: int, dtype: str, column: str = "row") -> DataFrame:
    """(file, place, row): rows of headerless row-major files; rows of a file are numbered in order."""
    ship(spark)
    kind, real = DTYPES[dtype.upper()], dtype.upper() in ("FLOAT", "FLOAT32", "DOUBLE", "FLOAT64")
    element = pa.float64() if real else pa.int64()
    out = pa.schema([("file", pa.string()), ("place", pa.int64()), (column, pa.list_(element))])

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = np.frombuffer(content, kind)
                if len(m) % width:
                    raise ValueError(f"{file} does not hold rows of {width}")
                m = m.reshape(-1, width).astype("f8" if real else "i8")
                for i in range(0, len(m), 8192):
                    part = m[i : i + 8192]
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width), pa.int32()), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(i, i + len(part))), rows], schema=out)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, place long, {column} array<{'double' if real else 'bigint'}>")


def read_edges_binary(spark: SparkSession, path: str, width: int = 3, dtype: str = "INT") -> DataFrame:
    """Edges of a raw file; two columns get relation 0."""
    if width not in (2, 3):
        raise ValueError("edges have two or three columns")
    rows = read_matrix(spark, path, width, dtype)
    at = lambda i: F.get("row", F.lit(i))
    return rows.select("place", at(0).alias("src"), (at(1) if width == 3 else F.lit(0).cast("long")).alias("rel"), at(width - 1).alias("dst"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(bucket_id, n) of a file with one count a line, bucket (0, 0) first."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"\S+"), F.lit(0))).alias("bucket_id", "n")).select("bucket_id", F.col("n").cast("long").alias("n"))


def from_numpy(spark: SparkSession, edges: np.ndarray) -> DataFrame:
    """(src, rel, dst) of an in-memory array of two or three columns."""
    if edges.ndim != 2 or edges.shape[1] not in (2, 3):
        raise ValueError("edges have two or three columns")
    rel = edges[:, 1] if edges.shape[1] == 3 else np.zeros(len(edges), np.int64)
    return spark.createDataFrame(pa.table({"src": edges[:, 0].astype(np.int64), "rel": rel.astype(np.int64), "dst": edges[:, -1].astype(np.int64)}))


def read_description(spark: SparkSession, path: str) -> dict:
    """A dataset's description, from JSON text in any store Spark reads."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
