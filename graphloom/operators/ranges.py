"""Tables kept as parquet by ranges of ids: slices are read by their folders, and writes replace only the ranges they touch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.tables import index_add, index_put
from graphloom.runtime import materialize, release, sized_broadcast
from graphloom.sources.writers import exists


@dataclass
class RangedTable:
    """A table of rows by a dense ``id``; a folder holds ``width`` ids.

    A write first makes the new rows of the touched ranges, then replaces those folders; readers of other ranges never see
    it. A reader of a touched range may see it before or after; one writer at a time.
    """

    spark: SparkSession
    path: str
    width: int = 1 << 20

    def _ranged(self, df: DataFrame) -> DataFrame:
        return df.withColumn("range", F.floor(F.col("id") / F.lit(self.width)).cast("long"))

    def create(self, df: DataFrame) -> RangedTable:
        if exists(self.spark, self.path):
            raise FileExistsError(self.path)
        self._write(df)
        return self

    def _write(self, df: DataFrame) -> None:
        rows = self._ranged(df).repartition("range").sortWithinPartitions("range", "id")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("range").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().drop("range")

    def range_read(self, offset: int, n: int) -> DataFrame:
        """Rows of ids offset to offset + n; folders of other ranges are not listed in the scan."""
        if offset < 0 or n < 0:
            raise ValueError("a slice begins at 0 or later and has a length")
        first, last = offset // self.width, (offset + max(n, 1) - 1) // self.width
        return self._all().where(F.col("range").between(first, last) & (F.col("id") >= offset) & (F.col("id") < offset + n)).drop("range")

    def touched(self, values: DataFrame) -> DataFrame:
        """Present rows of the ranges that hold any id of the values."""
        ranges = materialize(self._ranged(values.select("id")).select("range").distinct(), "ranges")
        return self._all().join(sized_broadcast(ranges, 16), "range", "left_semi").drop("range")

    def _replace(self, rows: DataFrame) -> None:
        made = materialize(rows, "replaced")
        self._write(made)
        release(made)

    def put(self, values: DataFrame, column: str = "emb") -> None:
        """Overwrite a column of rows by id; ids that the table does not have are left out."""
        self._replace(index_put(self.touched(values), values, column))

    def add(self, values: DataFrame, column: str = "emb") -> None:
        """row += the sum of all values given for it."""
        self._replace(index_add(self.touched(values), values, column))

    def range_put(self, offset: int, rows: DataFrame) -> None:
        """Replace a slice by whole rows (id and all columns), whose ids lie from ``offset`` on in ranges of their own or others'."""
        if not rows.where((F.col("id") < offset) | F.col("id").isNull()).isEmpty():
            raise ValueError("a row of the slice lies before it")
        present = self.touched(rows) if exists(self.spark, self.path) else rows.limit(0)
        self._replace(present.join(rows.select("id"), "id", "left_anti").select(*rows.columns).unionByName(rows))

    def append(self, rows: DataFrame) -> None:
        """Rows after the last id, numbered on from it; ``rows`` have an id of their own from 0."""
        last = self._all().agg(F.max("id").alias("n")).first()["n"]
        self.range_put(0, rows.withColumn("id", F.col("id") + F.lit(-1 if last is None else last) + 1))
