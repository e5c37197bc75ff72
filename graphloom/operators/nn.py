"""Segment operators, attention, graph layers and the stage encoder, over rows (id, vec) and sampled edges (node, nbr)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.operators.sums import reduce_vectors, vector_width

Matrix = list[list[float]]


def segment_sum(rows: DataFrame, key: str = "node", width: int | None = None) -> DataFrame:
    """(key, vec): sums of vectors; ``width`` is their length where it is known."""
    return reduce_vectors(rows, key, "vec", "vec", width=width)


def segment_max(rows: DataFrame, key: str = "node", width: int | None = None) -> DataFrame:
    """(key, vec): maxima of vectors, element by element."""
    return reduce_vectors(rows, key, "vec", "vec", F.max, width)


def attention_softmax(scores: DataFrame) -> DataFrame:
    """(node, nbr, weight): softmax of (node, nbr, score) over a node's rows, stable."""
    top = scores.groupBy("node").agg(F.max("score").alias("top"))
    each = scores.join(top, "node").withColumn("e", F.exp(F.col("score") - F.col("top")))
    sums = each.groupBy("node").agg(F.sum("e").alias("s"))
    return each.join(sums, "node").select("node", "nbr", (F.col("e") / F.col("s")).alias("weight"))


def neighbour_sums(vectors: DataFrame, sampled: DataFrame) -> DataFrame:
    """(id, self, nbrs, deg): a node's vector, the sum of its sampled neighbours' and their number."""
    found = sampled.select("node", F.col("nbr").alias("id")).join(vectors, "id").select("node", "vec")
    sums = segment_sum(found, width=vector_width(vectors, "vec")).select(F.col("node").alias("id"), F.col("vec").alias("nbrs"))
    counts = sampled.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    joined = vectors.select("id", F.col("vec").alias("self")).join(sums, "id", "left").join(counts, "id", "left")
    return joined.withColumn("nbrs", F.coalesce("nbrs", F.transform("self", lambda x: F.lit(0.0)))).withColumn("deg", F.coalesce("deg", F.lit(0)))


def sage_layer(vectors: DataFrame, sampled: DataFrame, w1: Matrix, w2: Matrix | None = None, aggregator: str = "MEAN", bias: list[float] | None = None, act: str = "NONE") -> DataFrame:
    """GraphSage: GCN aggregation W1 (sum + self) / (deg + 1), or MEAN aggregation W1 self + W2 sum / max(deg, 1)."""
    j = neighbour_sums(vectors, sampled)
    if aggregator.upper() == "GCN":
        out = V.linear(V.scale(V.add(F.col("nbrs"), F.col("self")), 1 / (F.col("deg") + 1)), w1)
    else:
        out = V.add(V.linear(F.col("self"), w1), V.linear(V.scale(F.col("nbrs"), 1 / F.greatest(F.col("deg"), F.lit(1))), w2))
    return j.select("id", V.post_hook(out, _bias(bias), act).alias("vec"))


def _bias(bias: list[float] | None) -> Column | None:
    return None if bias is None else F.array(*[F.lit(float(b)) for b in bias])


def gcn_layer(vectors: DataFrame, sampled: DataFrame, w: Matrix, bias: list[float] | None = None, act: str = "NONE") -> DataFrame:
    """Symmetric normalisation by sampled degrees plus one, then W and the bias."""
    counts = sampled.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    scaled = vectors.join(counts, "id", "left").select("id", V.scale(F.col("vec"), 1 / F.sqrt(F.coalesce("d", F.lit(0)) + 1)).alias("vec"), F.coalesce("d", F.lit(0)).alias("d"))
    j = neighbour_sums(scaled.select("id", "vec"), sampled).join(scaled.select("id", "d"), "id")
    out = V.linear(V.scale(V.add(F.col("nbrs"), F.col("self")), 1 / F.sqrt(F.col("d") + 1)), w)
    return j.select("id", V.post_hook(out, _bias(bias), act).alias("vec"))


def gat_layer(vectors: DataFrame, sampled: DataFrame, heads: list[tuple[Matrix, list[float], list[float]]], average: bool = True, slope: float = 0.2, act: str = "NONE") -> DataFrame:
    """Attention over incoming neighbours and the node itself; a head is (W, weights of the node, weights of the neighbour)."""
    both = sampled.select("node", "nbr").unionByName(vectors.select(F.col("id").alias("node"), F.col("id").alias("nbr")))
    out = None
    for k, (w, own, other) in enumerate(heads):
        lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
        h = vectors.select("id", V.linear(F.col("vec"), w).alias("h"))
        h = h.select("id", "h", V.dot(F.col("h"), lit(own)).alias("a"), V.dot(F.col("h"), lit(other)).alias("b"))
        pairs = both.join(h.select(F.col("id").alias("node"), "a"), "node").join(h.select(F.col("id").alias("nbr"), "b", "h"), "nbr").withColumn("_row", F.monotonically_increasing_id())
        raw = F.col("a") + F.col("b")
        scored = pairs.withColumn("score", F.when(raw > 0, raw).otherwise(raw * F.lit(slope)))
        top = scored.groupBy("node").agg(F.max("score").alias("top"))
        each = scored.join(top, "node").withColumn("e", F.exp(F.col("score") - F.col("top")))
        sums = each.groupBy("node").agg(F.sum("e").alias("s"))
        part = segment_sum(each.select("node", V.scale(F.col("h"), F.col("e")).alias("vec")), width=len(w)).join(sums, "node").select(F.col("node").alias("id"), V.scale(F.col("vec"), 1 / F.col("s")).alias(f"h{k}"))
        out = part if out is None else out.join(part, "id")
    parts = [F.col(f"h{k}") for k in range(len(heads))]
    joined = parts[0]
    for p in parts[1:]:
        joined = V.add(joined, p) if average else F.concat(joined, p)
    if average:
        joined = V.scale(joined, F.lit(1.0 / len(parts)))
    return out.select("id", V.activation(joined, act).alias("vec"))


def rgcn_layer(vectors: DataFrame, sampled: DataFrame, relations: dict[int, Matrix], own: Matrix, bias: list[float] | None = None, act: str = "NONE") -> DataFrame:
    """mean over neighbours of W_r nbr, plus W self; relation matrices are parameters of the code."""
    nbr = sampled.select("node", "rel", F.col("nbr").alias("id")).join(vectors, "id")
    turned = None
    for r, w in relations.items():
        turned = F.when(F.col("rel") == r, V.linear(F.col("vec"), w)) if turned is None else turned.when(F.col("rel") == r, V.linear(F.col("vec"), w))
    sums = segment_sum(nbr.select("node", turned.alias("vec")), width=len(own)).select(F.col("node").alias("id"), F.col("vec").alias("sum"))
    counts = sampled.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    j = vectors.select("id", V.linear(F.col("vec"), own).alias("self")).join(sums, "id", "left").join(counts, "id", "left")
    mean = V.scale(F.coalesce("sum", F.transform("self", lambda x: F.lit(0.0))), 1 / F.greatest(F.coalesce("deg", F.lit(1)), F.lit(1)))
    return j.select("id", V.post_hook(V.add(F.col("self"), mean), _bias(bias), act).alias("vec"))


def embedding_layer(table: DataFrame, offset: int, width: int) -> DataFrame:
    return table.select("id", V.columns(F.col("vec"), offset, width).alias("vec"))


def concat_reduction(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("id", F.col("vec").alias("_o")), "id").select("id", F.concat("vec", "_o").alias("vec"))


def linear_reduction(parts: list[DataFrame], w: Matrix) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = concat_reduction(out, p)
    return out.select("id", V.linear(F.col("vec"), w).alias("vec"))


@dataclass
class Encoder:
    """Stages of layers: a stage maps a list of (id, vec) tables to one; the last stage's output is the encoding."""

    stages: list[Callable[[list[DataFrame]], DataFrame]] = field(default_factory=list)

    def forward(self, inputs: list[DataFrame]) -> DataFrame:
        current = inputs
        for stage in self.stages:
            current = [stage(current)]
        if len(current) != 1:
            raise ValueError("an encoder ends in one table")
        return current[0]
