"""Trainable graph encoders: forward over sampled hops, and backward by the adjoints of the segment operators.

A layer's aggregation is a sparse matrix, kept as rows (node, nbr, w): its product with a vector table is a join and a
sum by node, and the adjoint is the same over the transposed rows. Weights are a table of matrix rows with their
optimiser's slots; they have as many numbers as the layers' dimensions say, so each step sends them to the tasks. Their
gradients are outer products, added up inside each task and then between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.hashing import uniform
from graphloom.operators import grid as R
from graphloom.operators import kernels as K
from graphloom.operators.batches import assign_batches
from graphloom.operators.graph import hops
from graphloom.runtime import materialize, release, ship

KINDS = ("SAGE_MEAN", "SAGE_GCN", "GCN")
ACTIVATIONS = ("NONE", "RELU", "SIGMOID")


@dataclass(frozen=True)
class Layer:
    """One graph layer. ``sampler``: options of a hop (kind, most, rate).

    SAGE_MEAN: W1 self + W2 mean of neighbours; SAGE_GCN: W1 (sum of neighbours + self) / (degree + 1); GCN: W1 applied to
    the symmetrically normalised sum; each with its bias, then the activation. Degrees are those of the sampled rows.
    """

    kind: str
    inputs: int
    outputs: int
    activation: str = "NONE"
    bias: bool = True
    sampler: tuple[tuple[str, object], ...] = (("kind", "ALL"),)

    def __post_init__(self):
        if self.kind not in KINDS or self.activation not in ACTIVATIONS or self.inputs < 1 or self.outputs < 1:
            raise ValueError(f"no training of a layer {self.kind} {self.inputs} x {self.outputs} {self.activation}")

    def names(self) -> list[str]:
        return ["w1", *(["w2"] if self.kind == "SAGE_MEAN" else []), *(["b"] if self.bias else [])]


def new_weights(spark: SparkSession, layers: list[Layer], salt: str = "weights") -> DataFrame:
    """(param, emb): rows of all matrices, Glorot-uniform by the whole matrix's fans; biases are zero. param: layer/name/row."""
    rows = [(f"{k}/{n}/{o:06d}", n, x.inputs if n != "b" else x.outputs, x.outputs) for k, x in enumerate(layers) for n in x.names() for o in range(x.outputs if n != "b" else 1)]
    table = spark.createDataFrame(rows, "param string, name string, width int, outputs int")
    cells = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda d: F.when(F.col("name") == "b", F.lit(0.0)).otherwise((uniform(F.concat("param", F.lit("/"), d.cast("string")), salt) * 2 - 1) * F.sqrt(F.lit(6.0) / (F.col("width") + F.col("outputs")))))
    return materialize(table.select("param", cells.alias("emb")), "weights")


def read_weights(weights: DataFrame, layers: list[Layer]) -> list[dict[str, np.ndarray]]:
    """Matrices of every layer; the table has as many rows as the layers have output dimensions."""
    rows = {r["param"]: r["emb"] for r in weights.select("param", "emb").collect()}
    return [{n: np.array([rows[f"{k}/{n}/{o:06d}"] for o in range(x.outputs if n != "b" else 1)]) for n in x.names()} for k, x in enumerate(layers)]


def aggregation(layer: Layer, sampled: DataFrame, targets: DataFrame) -> DataFrame:
    """(node, nbr, w) of a layer's aggregation for the target nodes (node)."""
    rows = sampled.select("node", "nbr")
    counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    if layer.kind == "SAGE_MEAN":
        return rows.join(counts, "node").select("node", "nbr", (1 / F.col("d")).alias("w"))
    own = targets.select("node", F.col("node").alias("nbr"))
    every = rows.unionByName(own).join(counts, "node", "left").withColumn("d", F.coalesce("d", F.lit(0)) + 1)
    if layer.kind == "SAGE_GCN":
        return every.select("node", "nbr", (1 / F.col("d")).alias("w"))
    other = counts.select(F.col("node").alias("nbr"), F.col("d").alias("o"))
    return every.join(other, "nbr", "left").select("node", "nbr", (1 / F.sqrt(F.col("d") * (F.coalesce("o", F.lit(0)) + 1))).alias("w"))


def product(rows: DataFrame, vectors: DataFrame, to: str = "node", source: str = "nbr") -> DataFrame:
    """(id, g): the sparse matrix (node, nbr, w) times vectors (id, g), or its transpose with ``to`` and ``source`` exchanged.

    Weighted vectors are added up by node inside each Arrow batch before they are shuffled, which also spreads hubs. Of
    many rows, vectors meet them in a grid of blocks, so that none travels with each row. ``rows`` is a written table.
    """
    ship(rows.sparkSession)
    if rows.count() > R.MANY:
        return K.add_vectors(R.product(rows, vectors, to, source))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids, places = np.unique(b.column("id").to_numpy(), return_inverse=True)
            g = K.matrix(pa.chunked_array([b.column("g")])) * b.column("w").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(ids), K.vectors(K.add_rows(len(ids), [(places, g)], g.shape[1]))], names=["id", "g"])

    found = rows.select(F.col(to).alias("_to"), F.col(source).alias("id"), "w").join(vectors.select("id", "g"), "id").select(F.col("_to").alias("id"), "w", "g")
    return K.add_vectors(found.mapInArrow(run, "id long, g array<double>"))


def _pre(layer: Layer, w: dict[str, np.ndarray], x: np.ndarray, agg: np.ndarray) -> np.ndarray:
    out = x @ w["w1"].T + agg @ w["w2"].T if layer.kind == "SAGE_MEAN" else agg @ w["w1"].T
    return out + w["b"] if layer.bias else out


def _activated(kind: str, x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) if kind == "RELU" else 1 / (1 + np.exp(-x)) if kind == "SIGMOID" else x


def _slope(kind: str, h: np.ndarray) -> np.ndarray | float:
    """The activation's slope, by its value."""
    return (h > 0).astype(float) if kind == "RELU" else h * (1 - h) if kind == "SIGMOID" else 1.0


@dataclass
class Forward:
    """What the backward pass needs: each layer's aggregation rows, and its written (id, x, agg, g) with g the output."""

    rows: list[DataFrame]
    layers: list[DataFrame]

    @property
    def output(self) -> DataFrame:
        """(id, g) of the last layer, the roots among them."""
        return self.layers[-1].select("id", "g")

    def release(self) -> None:
        for t in (*self.rows, *self.layers):
            release(t)


def forward(roots: DataFrame, edges: DataFrame, inputs: DataFrame, layers: list[Layer], weights: list[dict[str, np.ndarray]], use_incoming: bool = False, use_outgoing: bool = True) -> Forward:
    """Encodings of roots (node) over a graph (src, rel, dst) from inputs (id, vec): a hop for each layer, the outermost first.

    The layer next to the inputs works on all nodes but the outermost hop's, each further one on one hop less. Neighbours
    without an input do not count.
    """
    spark = roots.sparkSession
    ship(spark)
    nodes, found = hops(roots, edges, [dict(x.sampler) for x in reversed(layers)], use_incoming, use_outgoing)
    depth, current, rows, kept = len(layers), inputs.select("id", F.col("vec").alias("g")), [], []
    for k, layer in enumerate(layers):
        targets = nodes.where(F.col("hop") <= depth - 1 - k).select("node")
        sampled = found.where(F.col("hop") <= depth - k).join(current.select(F.col("id").alias("nbr")), "nbr", "left_semi")
        a = materialize(aggregation(layer, sampled, targets), "aggregation")
        summed = product(a, current).select("id", F.col("g").alias("agg"))
        joined = targets.select(F.col("node").alias("id")).join(current.select("id", F.col("g").alias("x")), "id").join(summed, "id", "left")
        joined = joined.withColumn("agg", F.coalesce("agg", F.transform("x", lambda v: F.lit(0.0))))
        w = weights[k]

        def run(batches, layer=layer, w=w):
            for b in batches:
                x, agg = (K.matrix(pa.chunked_array([b.column(c)])) for c in ("x", "agg"))
                out = _activated(layer.activation, _pre(layer, w, x, agg)) if b.num_rows else np.zeros((0, layer.outputs))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), b.column("agg"), K.vectors(out)], names=["id", "x", "agg", "g"])

        done = materialize(joined.select("id", "x", "agg").mapInArrow(run, "id long, x array<double>, agg array<double>, g array<double>"), "layer")
        rows.append(a)
        kept.append(done)
        current = done.select("id", "g")
    return Forward(rows, kept)


def backward(f: Forward, grads: DataFrame, layers: list[Layer], weights: list[dict[str, np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """(weight gradients (param, g), input gradients (id, g)) from gradients (id, g) in the encodings."""
    current, params = grads.select("id", "g"), None
    for k in reversed(range(len(layers))):
        layer, w = layers[k], weights[k]
        agg_w, self_w = (w["w2"], w["w1"]) if layer.kind == "SAGE_MEAN" else (w["w1"], None)
        joined = f.layers[k].select("id", "x", "agg", F.col("g").alias("h")).join(current, "id").select("id", "x", "agg", "h", "g")

        def run(batches, layer=layer, agg_w=agg_w, self_w=self_w, k=k):
            total = {n: 0.0 for n in layer.names()}
            names = ["kind", "id", "param", "g"]
            for b in batches:
                if not b.num_rows:
                    continue
                x, agg, h, g = (K.matrix(pa.chunked_array([b.column(c)])) for c in ("x", "agg", "h", "g"))
                pre = g * _slope(layer.activation, h)
                total["w2" if self_w is not None else "w1"] = total["w2" if self_w is not None else "w1"] + pre.T @ agg
                if self_w is not None:
                    total["w1"] = total["w1"] + pre.T @ x
                if layer.bias:
                    total["b"] = total["b"] + pre.sum(0, keepdims=True)
                ids = b.column("id")
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(ids)), ids, pa.nulls(len(ids), pa.string()), K.vectors(pre @ agg_w)], names=names)
                if self_w is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([1] * len(ids)), ids, pa.nulls(len(ids), pa.string()), K.vectors(pre @ self_w)], names=names)
            for n, m in total.items():
                if isinstance(m, np.ndarray):
                    yield pa.RecordBatch.from_arrays([pa.array([2] * len(m)), pa.array(range(len(m)), pa.int64()), pa.array([f"{k}/{n}/{o:06d}" for o in range(len(m))]), K.vectors(m)], names=names)

        found = materialize(joined.mapInArrow(run, "kind long, id long, param string, g array<double>"), "backward")
        own = found.where("kind = 2").select("param", "g")
        params = own if params is None else params.unionByName(own)
        through = product(f.rows[k], found.where("kind = 0").select("id", "g"), "nbr", "node")
        current = K.add_vectors(through.unionByName(found.where("kind = 1").select("id", "g")))
    numbered = params.groupBy("param").agg(F.collect_list("g").alias("gs"))  # as many vectors as there were tasks
    summed = numbered.select("param", F.aggregate(F.slice("gs", 2, F.greatest(F.size("gs") - 1, F.lit(0))), F.get("gs", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda p, q: p + q)).alias("g"))
    return summed, current


# Node classification.
def node_batches(labels: DataFrame, size: int, salt: str = "nodes") -> DataFrame:
    """(batch_id, position, id, y) of labelled nodes (id, y), in hash order."""
    return assign_batches(labels.where("y is not null").select("id", "y"), F.col("id"), size, salt)


def class_gradients(logits: DataFrame, labels: DataFrame, reduction: str = "SUM") -> DataFrame:
    """(id, g, loss): softmax cross-entropy's gradient in logits (id, g) of nodes labelled (id, y); a class beyond the logits raises."""
    ship(logits.sparkSession)
    rows = logits.join(labels.select("id", F.col("y").cast("long").alias("y")), "id").select("id", "y", "g")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            z, y = K.matrix(pa.chunked_array([b.column("g")])), b.column("y").to_numpy()
            if y.min() < 0 or y.max() >= z.shape[1]:
                raise ValueError(f"classes lie in 0 to {z.shape[1] - 1}")
            top = z.max(1, keepdims=True)
            lse = top + np.log(np.exp(z - top).sum(1, keepdims=True))
            g = np.exp(z - lse)
            at = np.arange(len(y))
            loss = lse[:, 0] - z[at, y]
            g[at, y] -= 1
            yield pa.RecordBatch.from_arrays([b.column("id"), K.vectors(g), pa.array(loss)], names=["id", "g", "loss"])

    out = rows.mapInArrow(run, "id long, g array<double>, loss double")
    if reduction.upper() == "MEAN":
        n = F.lit(max(rows.count(), 1))
        out = out.select("id", F.transform("g", lambda x: x / n).alias("g"), (F.col("loss") / n).alias("loss"))
    elif reduction.upper() != "SUM":
        raise ValueError(f"unknown reduction {reduction}")
    return out


def concatenated(embeddings: DataFrame | None, features: DataFrame | None) -> DataFrame:
    """(id, vec): a node's embedding, its fixed features, or both, the embedding first."""
    if embeddings is None and features is None:
        raise ValueError("an encoder needs embeddings or features")
    if embeddings is None or features is None:
        return (features if embeddings is None else embeddings).select("id", F.col("vec" if embeddings is None else "emb").alias("vec"))
    return embeddings.select("id", "emb").join(features.select("id", F.col("vec").cast("array<double>").alias("_f")), "id").select("id", F.concat("emb", "_f").alias("vec"))


def leading(grads: DataFrame, width: int) -> DataFrame:
    """The part of input gradients that belongs to the embeddings."""
    return grads.select("id", F.slice("g", 1, width).alias("g"))

