"""From raw edges to numbered, split and partitioned edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.hashing import SPAN, h48
from graphloom.runtime import materialize, number_rows, sized_broadcast


def node_set(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct endpoints, and known nodes that may have no edge."""
    nodes = edges.select(F.col("src").alias("raw")).union(edges.select("dst"))
    if known is not None:
        nodes = nodes.union(known.select("raw"))
    return nodes.where("raw is not null").distinct()


def random_ids(values: DataFrame, salt: str = "nodes") -> DataFrame:
    """(raw, id): dense ids in hash order."""
    return number_rows(values.withColumn("_h", h48(F.col("raw"), salt)), [F.col("_h"), F.col("raw")], "id").drop("_h")


def sequential_ids(values: DataFrame) -> DataFrame:
    """(raw, id): dense ids in the order of the values."""
    return number_rows(values, [F.col("raw")], "id")


def node_degrees_raw(edges: DataFrame) -> DataFrame:
    """(raw, degree): in- plus out-degree."""
    ends = edges.select(F.col("src").alias("raw")).union(edges.select("dst"))
    return ends.groupBy("raw").agg(F.count(F.lit(1)).alias("degree"))


def degree_ordered_ids(edges: DataFrame, top: int, known: DataFrame | None = None, salt: str = "nodes") -> DataFrame:
    """(raw, id): the ``top`` nodes of highest degree get the first ids, all others follow in hash order."""
    nodes = node_set(edges, known).join(node_degrees_raw(edges), "raw", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    first = nodes.orderBy(F.desc("degree"), "raw").limit(top).select("raw", F.lit(True).alias("_first"))
    marked = nodes.join(first, "raw", "left").withColumn("_h", h48(F.col("raw"), salt))
    lead = F.coalesce("_first", F.lit(False))
    order = [(~lead).cast("int"), F.when(lead, -F.col("degree")).otherwise(F.lit(0)), F.when(lead, F.lit(0)).otherwise(F.col("_h")), F.col("raw")]
    keyed = marked.select("raw", *[o.alias(f"_o{i}") for i, o in enumerate(order[:3])])
    return number_rows(keyed, [F.col("_o0"), F.col("_o1"), F.col("_o2"), F.col("raw")], "id").select("raw", "id")


def train_first_ids(edges: DataFrame, train: DataFrame, salt: str = "nodes") -> DataFrame:
    """(raw, id): train nodes get ids 0 to n - 1 in value order, all others follow in hash order."""
    nodes = node_set(edges, train).join(train.select("raw", F.lit(1).alias("_train")).distinct(), "raw", "left")
    keyed = nodes.select("raw", F.when(F.col("_train") == 1, 0).otherwise(1).alias("_o0"), F.when(F.col("_train") == 1, F.lit(0)).otherwise(h48(F.col("raw"), salt)).alias("_o1"))
    return number_rows(keyed, [F.col("_o0"), F.col("_o1"), F.col("raw")], "id").select("raw", "id")


def combined_first_ids(edges: DataFrame, train: DataFrame, top: int, salt: str = "nodes") -> DataFrame:
    """(raw, id): the union of train and highest-degree nodes first, in hash order, then the rest."""
    high = node_degrees_raw(edges).orderBy(F.desc("degree"), "raw").limit(top).select("raw")
    first = high.union(train.select("raw")).distinct().select("raw", F.lit(1).alias("_first"))
    nodes = node_set(edges, train).join(first, "raw", "left").select("raw", F.coalesce(1 - F.col("_first"), F.lit(1)).alias("_o0"), h48(F.col("raw"), salt).alias("_o1"))
    return number_rows(nodes, [F.col("_o0"), F.col("_o1"), F.col("raw")], "id").select("raw", "id")


def apply_mapping(edges: DataFrame, nodes: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Edges with dense ids; edges with an unmapped end are dropped. Relation tables are small: the planner decides."""
    out = edges.join(nodes.select(F.col("raw").alias("src"), F.col("id").alias("_s")), "src").join(nodes.select(F.col("raw").alias("dst"), F.col("id").alias("_d")), "dst")
    if relations is not None:
        out = out.join(relations.select(F.col("raw").alias("rel"), F.col("id").alias("_r")), "rel").withColumn("rel", F.col("_r")).drop("_r")
    return out.withColumn("src", F.col("_s")).withColumn("dst", F.col("_d")).drop("_s", "_d").select(*edges.columns)


def apply_mapping_1d(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    return ids.join(mapping, "raw").select(F.col("id"))


def remap(edge_lists: dict[str, DataFrame], known: DataFrame | None = None, typed: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(edges with split, node mapping, relation mapping) of named edge lists."""
    every = None
    for split, edges in edge_lists.items():
        part = edges.withColumn("split", F.lit(split))
        every = part if every is None else every.unionByName(part)
    nodes = random_ids(node_set(every, known))
    relations = random_ids(every.select(F.col("rel").alias("raw")).where("raw is not null").distinct(), "relations") if typed else None
    return apply_mapping(every, nodes, relations), nodes, relations


def split_points(n: int, fractions: tuple[float, ...]) -> list[int]:
    """Row counts at which splits end: floors of n times each fraction, the last at the floor of n times the sum."""
    if len(fractions) not in (2, 3):
        raise ValueError("two or three fractions are needed")
    ends, at = [], 0
    for f in fractions[:-1]:
        at += int(n * f)
        ends.append(at)
    return [*ends, int(sum(fractions) * n)]


def split_edges(edges: DataFrame, key: Column, fractions: tuple[float, ...], salt: str = "split") -> DataFrame:
    """Edges with a split column, exact in size, in hash order of the key; rows beyond the last point are left out."""
    names = ("train", "test") if len(fractions) == 2 else ("train", "validation", "test")
    keyed = edges.withColumn("_k", key).withColumn("_h", h48(F.col("_k"), salt))
    numbered = number_rows(keyed, [F.col("_h"), F.col("_k")], "_row")
    ends = split_points(edges.count(), fractions)
    split = F.when(F.col("_row") < ends[0], names[0])
    for end, name in zip(ends[1:], names[1:], strict=True):
        split = split.when(F.col("_row") < end, name)
    return numbered.withColumn("split", split).where("split is not null").drop("_k", "_h", "_row")


#: Ranges of the hash in which keys are counted to find where a split ends.
RANGES = 1 << 12


def with_split(edges: DataFrame, key: Column, fractions: tuple[float, ...], salt: str = "split") -> DataFrame:
    """The same of a written table whose keys are distinct and not null, found without sorting or writing the edges: the first key of
    each part is looked up in the one range of the hash that holds it, and each edge is compared with those."""
    names = ("train", "test") if len(fractions) == 2 else ("train", "validation", "test")
    h = h48(key, salt)
    keyed = edges.select(h.alias("h"), key.alias("k"), F.floor(h * F.lit(RANGES) / F.lit(SPAN)).alias("r"))
    sizes = sorted((r["r"], r["count"]) for r in keyed.groupBy("r").count().collect())
    split = None
    for end, name in zip(split_points(sum(n for _, n in sizes), fractions), names, strict=True):
        for r, n in sizes:
            if end < n:
                first = keyed.where(F.col("r") == F.lit(r)).orderBy("h", "k").offset(end).limit(1).first()
                before = (h < F.lit(first["h"])) | ((h == F.lit(first["h"])) & (key < F.lit(first["k"])))
                break
            end -= n
        else:
            before = F.lit(True)
        split = F.when(before, name) if split is None else split.when(before, name)
    return edges.withColumn("split", split).where("split is not null")


def partition_size(nodes: int, partitions: int) -> int:
    return math.ceil(nodes / partitions)


def with_buckets(edges: DataFrame, nodes: int, partitions: int) -> DataFrame:
    """Edges with src_part, dst_part and bucket_id."""
    size = partition_size(nodes, partitions)
    part = lambda c: F.floor(F.col(c) / F.lit(size)).cast("int")
    return edges.withColumn("src_part", part("src")).withColumn("dst_part", part("dst")).withColumn("bucket_id", F.col("src_part") * F.lit(partitions) + F.col("dst_part"))


def bucket_counts(edges: DataFrame, partitions: int) -> DataFrame:
    """Edges of every bucket, empty ones included."""
    counts = edges.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.sparkSession.range(partitions * partitions).select(F.col("id").cast("int").alias("bucket_id"))
    return grid.join(counts, "bucket_id", "left").select("bucket_id", F.coalesce("n", F.lit(0)).alias("n"))


def repartition_nodes(edges: DataFrame, permutation: DataFrame, nodes: int, partitions: int) -> DataFrame:
    """Buckets after the nodes are renumbered by (id, new_id)."""
    moved = apply_mapping(edges, permutation.select(F.col("id").alias("raw"), F.col("new_id").alias("id")))
    return with_buckets(moved, nodes, partitions)


def id_count(df: DataFrame, column: str) -> DataFrame:
    """One row: the largest id plus one."""
    return df.agg((F.max(column) + 1).alias("n"))


def shuffle_rows(df: DataFrame, key: Column, within: str | None = None, salt: str = "shuffle") -> DataFrame:
    """Rows with a position in hash order, inside each bucket where one is named."""
    keyed = df.withColumn("_k", key).withColumn("_h", h48(F.col("_k"), salt))
    if within:  # a bucket's rows follow each other in the whole order, so its first number is taken off
        rows = number_rows(keyed, [F.col(within), F.col("_h"), F.col("_k")], "_row").drop("_k", "_h")
        first = materialize(rows.groupBy(within).agg(F.min("_row").alias("_first")), "firsts")
        return rows.join(sized_broadcast(first, 16), within).withColumn("position", F.col("_row") - F.col("_first")).drop("_row", "_first")
    return number_rows(keyed, [F.col("_h"), F.col("_k")], "position").drop("_k", "_h")
