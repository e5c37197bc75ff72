"""Table operators: the storage contract (gather, add, put, range, shuffle, sort) on keyed DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators.sums import reduce_vectors, vector_width


def index_read(ids: DataFrame, table: DataFrame) -> DataFrame:
    """Gather rows of a table by id; the planner broadcasts the smaller side only below its size limit."""
    return ids.join(table, "id")


def index_add(table: DataFrame, values: DataFrame, column: str = "emb") -> DataFrame:
    """row += the sum of all values given for it; vectors of repeated ids are summed first."""
    joined = table.join(reduce_vectors(values, "id", column, "_add", width=vector_width(table, column)), "id", "left")
    return joined.withColumn(column, F.when(F.col("_add").isNull(), F.col(column)).otherwise(V.add(F.col(column), F.col("_add")))).drop("_add")


def index_put(table: DataFrame, values: DataFrame, column: str = "emb") -> DataFrame:
    """Overwrite rows by id."""
    return table.join(values.select("id", F.col(column).alias("_new")), "id", "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def range_read(table: DataFrame, offset: int, n: int) -> DataFrame:
    return table.where((F.col("id") >= offset) & (F.col("id") < offset + n))


def append(table: DataFrame, values: DataFrame) -> DataFrame:
    return table.unionByName(values)


def sort_rows(edges: DataFrame, by_src: bool = True, within: str | None = None) -> DataFrame:
    order: list[str | Column] = ["src" if by_src else "dst", "rel", "dst" if by_src else "src"]
    return edges.orderBy(*([within] if within else []), *order)


@dataclass
class GraphTables:
    """The named tables of a graph: edges (with split), nodes, embeddings and states, relations, features, labels."""

    edges: DataFrame
    nodes: DataFrame | None = None
    node_embeddings: DataFrame | None = None
    relation_embeddings: DataFrame | None = None
    generator_embeddings: DataFrame | None = None
    weights: DataFrame | None = None
    features: DataFrame | None = None
    labels: DataFrame | None = None
    encoded: DataFrame | None = None
    filter_edges: list[DataFrame] = field(default_factory=list)

    def split(self, name: str) -> DataFrame:
        return self.edges.where(F.col("split") == name)

    def all_edges(self) -> DataFrame:
        from graphloom.operators.graph import union_edges

        return union_edges(self.edges, *self.filter_edges)

    def check(self) -> None:
        """No negative ends, no ends without a node, no nulls."""
        bad = self.edges.where("src is null or dst is null or src < 0 or dst < 0")
        if not bad.isEmpty():
            raise ValueError("edges with missing or negative ends")
        if self.nodes is not None:
            ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst"))
            if not ends.join(self.nodes, "id", "left_anti").isEmpty():
                raise ValueError("edges whose ends are not in the node table")


def assert_no_nans(df: DataFrame, column: str) -> None:
    if not df.where(F.isnan(column)).isEmpty():
        raise ValueError(f"{column} has NaN")


def assert_no_negatives(df: DataFrame, column: str) -> None:
    if not df.where(F.col(column) < 0).isEmpty():
        raise ValueError(f"{column} is negative")


def assert_in_range(df: DataFrame, column: str, low: float, high: float) -> None:
    """Raises where a value lies outside [low, high]."""
    if not df.where((F.col(column) < low) | (F.col(column) > high)).isEmpty():
        raise ValueError(f"{column} leaves [{low}, {high}]")
