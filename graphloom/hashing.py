"""Reproducible pseudo-randomness: a 48-bit md5 hash of a value and a salt, as a Column and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = float(1 << 48)


def h48(x: Column, salt: str) -> Column:
    """48 bits of md5('x:salt') as a long."""
    text = F.concat(x.cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(x: Column, salt: str) -> Column:
    """A double in [0, 1)."""
    return h48(x, salt) / F.lit(SPAN)


def h48_sql(x: str, salt: str) -> str:
    """The same hash in DuckDB."""
    return f"CAST(('0x' || substr(md5(CAST({x} AS VARCHAR) || ':{salt}'), 1, 12)) AS BIGINT)"


def uniform_sql(x: str, salt: str) -> str:
    return f"({h48_sql(x, salt)} / {SPAN}::DOUBLE)"
