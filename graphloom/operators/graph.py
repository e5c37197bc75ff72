"""Neighbour access: degrees, offsets, expansion, sampling and hops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.hashing import h48, uniform
from graphloom.runtime import materialize, number_rows


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of every node, isolated ones included."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(counts, "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def offsets(counted: DataFrame, degree: str, width: int = 1 << 16) -> DataFrame:
    """(id, degree, start): where each node's edges begin in id order. Ids are dense, so ranges of ``width`` ids are summed first."""
    rows = counted.select("id", F.col(degree).alias("degree"), F.floor(F.col("id") / F.lit(width)).alias("_b"))
    before = lambda w: F.coalesce(F.sum("degree").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("_b").agg(F.sum("degree").alias("degree"))
    sums = sums.select("_b", before(Window.orderBy("_b")).alias("_base"))
    inside = rows.withColumn("_in", before(Window.partitionBy("_b").orderBy("id")))
    return inside.join(F.broadcast(sums), "_b").select("id", "degree", (F.col("_base") + F.col("_in")).alias("start"))


def neighbours(ids: DataFrame, edges: DataFrame, incoming: bool = False) -> DataFrame:
    """(node, nbr, rel, direction): all neighbours of the given (node) rows."""
    key, other = ("dst", "src") if incoming else ("src", "dst")
    return ids.join(edges.select(F.col(key).alias("node"), F.col(other).alias("nbr"), "rel"), "node").withColumn("direction", F.lit("in" if incoming else "out"))


def sample_all(ids: DataFrame, edges: DataFrame, incoming: bool = False) -> DataFrame:
    return neighbours(ids, edges, incoming)


@dataclass
class Adjacency:
    """Neighbour lists as one numbered table, so that a draw is a join on a row number and a hub's list is spread over tasks.

    ``rows``: (number, node, nbr, rel, direction) in order of (node, nbr, rel); ``starts``: (node, start, degree).
    """

    rows: DataFrame
    starts: DataFrame


def adjacency(edges: DataFrame, incoming: bool = False, ids: DataFrame | None = None) -> Adjacency:
    """The index of all edges, or of those of the given (node) rows; rows are range-partitioned by the whole key."""
    key, other = ("dst", "src") if incoming else ("src", "dst")
    found = edges.select(F.col(key).alias("node"), F.col(other).alias("nbr"), "rel") if ids is None else neighbours(ids, edges, incoming).select("node", "nbr", "rel")
    rows = number_rows(found, [F.col("node"), F.col("nbr"), F.col("rel")], "number")
    starts = rows.groupBy("node").agg(F.min("number").alias("start"), F.count(F.lit(1)).alias("degree"))
    return Adjacency(rows.withColumn("direction", F.lit("in" if incoming else "out")), materialize(starts, "starts"))


def sample_uniform(ids: DataFrame, edges: DataFrame, most: int, incoming: bool = False, salt: str = "uniform", index: Adjacency | None = None) -> DataFrame:
    """All neighbours up to ``most``; beyond, ``most`` draws with replacement. ``draw`` numbers a node's rows.

    A draw is a place in the node's list, which is a row number of the index: nothing is joined or windowed by node but
    the list's start and length.
    """
    found = index or adjacency(edges, incoming, ids)
    long = lambda x: F.lit(x).cast("long")
    wanted = found.starts.join(ids.select("node").distinct(), "node").withColumn("draw", F.explode(F.sequence(long(0), F.least(F.col("degree"), long(most)) - 1)))
    place = F.when(F.col("degree") <= most, F.col("draw")).otherwise(h48(F.concat_ws("-", "node", "draw"), salt) % F.col("degree"))
    drawn = wanted.select("draw", (F.col("start") + place).alias("number"))
    return drawn.join(found.rows, "number").select("node", "draw", "nbr", "rel", "direction")


def sample_dropout(ids: DataFrame, edges: DataFrame, rate: float, incoming: bool = False, salt: str = "dropout") -> DataFrame:
    """A neighbour stays if its hash uniform is at least ``rate``."""
    found = neighbours(ids, edges, incoming)
    return found.where(uniform(F.concat_ws("-", "node", "nbr", "rel"), salt) >= F.lit(rate))


def sample(ids: DataFrame, edges: DataFrame, kind: str, incoming: bool = False, most: int = -1, rate: float = 0.0, index: Adjacency | None = None) -> DataFrame:
    """Sampler by name; a negative ``most`` means all."""
    kind = kind.upper()
    if kind == "ALL" or kind == "UNIFORM" and most < 0:
        return sample_all(ids, edges, incoming)
    if kind == "UNIFORM":
        return sample_uniform(ids, edges, most, incoming, index=index)
    if kind == "DROPOUT":
        return sample_dropout(ids, edges, rate, incoming)
    raise ValueError(f"unknown sampler {kind}")


def hops(roots: DataFrame, edges: DataFrame, layers: list[dict], use_incoming: bool = False, use_outgoing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes by hop, sampled edges by hop) of a layered neighbourhood: each layer expands the frontier only.

    Hop 0 holds the roots; a node belongs to the first hop that reaches it.
    """
    wide = [x for x in layers if x.get("kind", "").upper() == "UNIFORM" and x.get("most", -1) >= 0]
    index = {incoming: adjacency(edges, incoming) for wanted, incoming in ((use_incoming, True), (use_outgoing, False)) if wanted and wide}
    seen = materialize(roots.select("node").distinct().withColumn("hop", F.lit(0)), "hop")
    frontier, found = seen.select("node"), None
    for k, layer in enumerate(layers, 1):
        sampled = None
        for wanted, incoming in ((use_incoming, True), (use_outgoing, False)):
            if wanted:
                part = sample(frontier, edges, incoming=incoming, index=index.get(incoming), **layer).select("node", "nbr", "rel", "direction")
                sampled = part if sampled is None else sampled.unionByName(part)
        sampled = materialize(sampled.withColumn("hop", F.lit(k)), "hop-edges")
        found = sampled if found is None else found.unionByName(sampled)
        fresh = sampled.select(F.col("nbr").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        fresh = materialize(fresh.withColumn("hop", F.lit(k)), "hop")
        seen, frontier = seen.unionByName(fresh), fresh.select("node")
    return seen, found


def next_layer(nodes: DataFrame, current: int) -> DataFrame:
    """The neighbourhood without its outermost hop."""
    return nodes.where(F.col("hop") < current)


def local_ids(*lists: DataFrame) -> DataFrame:
    """(id, local): distinct ids of the lists and their positions in id order."""
    every = lists[0]
    for x in lists[1:]:
        every = every.union(x)
    return number_rows(every.distinct(), [F.col("id")], "local")


def apply_local(ids: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    return ids.join(mapping.select(F.col("id").alias(column), F.col("local").alias(f"{column}_local")), column)


def union_edges(*tables: DataFrame) -> DataFrame:
    """All known edges, once each: what false negatives are looked up in."""
    every = tables[0].select("src", "rel", "dst")
    for t in tables[1:]:
        every = every.unionByName(t.select("src", "rel", "dst"))
    return every.distinct()


def resident_subgraph(edges: DataFrame, schedule: DataFrame) -> DataFrame:
    """(step, src, rel, dst): the edges both of whose partitions are loaded at each step."""
    a = schedule.select("step", F.col("part").alias("src_part"))
    b = schedule.select("step", F.col("part").alias("dst_part"))
    return edges.join(a.join(b, "step"), ["src_part", "dst_part"]).select("step", "src", "rel", "dst")
