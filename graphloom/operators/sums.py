"""Sums and maxima of vectors by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest vectors that are brought together with a buffer for each element; it changes the plan, not the result.
WIDTH = 256


def vector_width(table: DataFrame, column: str = "emb") -> int:
    """Length of a table's longest vector; 0 for an empty table."""
    return max(table.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0, 0)


def reduce_vectors(rows: DataFrame, key: str, column: str, out: str, each: Callable[[Column], Column] = F.sum, width: int | None = None) -> DataFrame:
    """(key, out): vectors of the same key brought together element by element, as long as the longest of them.

    Null vectors do not count (a key with no other has no row), null elements are passed over (an element that is null in
    all vectors stays null), and an empty vector is a vector of no elements. Where the greatest ``width`` is known and not
    above ``WIDTH``, one hash aggregate has a buffer for each element and no row is made for each; a longer vector is then
    an error. Else elements are rows of a partial aggregation over (key, position).
    """
    rows = rows.where(F.col(column).isNotNull())
    if width is not None and 0 < width <= WIDTH:
        rows = rows.groupBy(key).agg(F.max(F.size(column)).alias("_n"), *[each(F.get(column, F.lit(i))).alias(f"_{i}") for i in range(width)])
        whole = F.slice(F.array(*[f"_{i}" for i in range(width)]), F.lit(1), F.col("_n"))
        return rows.select(key, F.when(F.col("_n") > width, F.raise_error(F.lit(f"a vector of {column} is longer than {width}"))).otherwise(whole).alias(out))
    cells = rows.select(key, F.posexplode_outer(column).alias("pos", "x")).groupBy(key, "pos").agg(each("x").alias("x"))
    found = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "x")))
    return cells.groupBy(key).agg(F.transform(F.array_sort(found), lambda c: c["x"]).alias(out))
