"""Shared pieces of the training-data operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import materialize, scratch_dir, ship, shuffle_partitions  # noqa: F401

#: Fixed value: ASCII white space; all other characters belong to words. bytes.split() uses the same set.
SPACE = " \t\n\x0b\x0c\r"
#: Rows in an Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped and small batches; column order of ``schema`` is what ``fn`` yields."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts_of(b: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a batch; null counts as empty."""
    return ["" if t is None else t for t in b.column(name).to_pylist()]


def draw(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the lowest hash of ``key``; few more than that ever reach one task."""
    count = rows.count()
    order = F.xxhash64(*key)
    if count > most:
        share = min(1.0, (most + 6 * most**0.5) / count)
        rows = rows.where(order / F.lit(2.0**64) + F.lit(0.5) <= F.lit(share))
    return rows.orderBy(order, *key).limit(most)


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the decimal id, modulo ``mod``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def crc_mod_py(doc_id, mod: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod
