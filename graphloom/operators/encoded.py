"""Training through an encoder: node classification, and link prediction over encoded nodes."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.operators import encoders as E
from graphloom.operators import kernels as K
from graphloom.operators.batches import assign_batches, negatives, with_chunks
from graphloom.operators.evaluate import accuracy, predicted
from graphloom.operators.sums import vector_width
from graphloom.operators.train import SIDES, Optim, Parameters, TrainConfig, apply_gradients, step_gradients
from graphloom.runtime import materialize, release


@dataclass
class Encoded:
    """Tables that training changes: trainable embeddings (id, emb) or none, weights (param, emb), relations or none; fixed
    features (id, vec) or none, and the steps taken."""

    embeddings: DataFrame | None
    weights: DataFrame
    features: DataFrame | None = None
    relations: DataFrame | None = None
    steps: int = 0

    def inputs(self) -> DataFrame:
        return E.concatenated(self.embeddings, self.features)

    def tables(self) -> dict[str, DataFrame]:
        named = {"nodes": self.embeddings, "weights": self.weights, "relations": self.relations}
        return {k: v for k, v in named.items() if v is not None}


@dataclass
class EncoderConfig:
    """Layers from the inputs on, directions that hops follow, and the size of node batches."""

    layers: list[E.Layer]
    use_incoming: bool = False
    use_outgoing: bool = True
    epochs: int = 1
    batch_size: int = 1000
    reduction: str = "SUM"
    sparse: Optim = field(default_factory=Optim)
    dense: Optim = field(default_factory=Optim)
    progress: list[dict] = field(default_factory=list)

    def __post_init__(self):
        for a, b in zip(self.layers, self.layers[1:], strict=False):
            if a.outputs != b.inputs:
                raise ValueError(f"a layer of {a.outputs} outputs is followed by one of {b.inputs} inputs")
        if not self.layers:
            raise ValueError("an encoder has layers")

    def run(self, roots: DataFrame, edges: DataFrame, p: Encoded) -> tuple[E.Forward, list]:
        weights = E.read_weights(p.weights, self.layers)
        return E.forward(roots, edges, p.inputs(), self.layers, weights, self.use_incoming, self.use_outgoing), weights


def updated(p: Encoded, c: EncoderConfig, weight_grads: DataFrame, input_grads: DataFrame) -> Encoded:
    """All tables after one step."""
    t = p.steps + 1
    weights = materialize(apply_gradients(p.weights, weight_grads, "param", c.dense, t), "weights")
    embeddings = p.embeddings
    if embeddings is not None:
        grads = E.leading(input_grads, vector_width(embeddings))
        embeddings = materialize(apply_gradients(embeddings, grads, "id", c.sparse, t), "nodes")
    return Encoded(embeddings, weights, p.features, p.relations, t)


def class_step_gradients(batch: DataFrame, edges: DataFrame, p: Encoded, c: EncoderConfig) -> tuple[DataFrame, DataFrame, float, E.Forward]:
    """(weight gradients, input gradients, loss, forward tables) of a batch of labelled nodes (id, y)."""
    f, weights = c.run(batch.select(F.col("id").alias("node")), edges, p)
    seen = Observation()
    top = materialize(E.class_gradients(f.output, batch, c.reduction).observe(seen, F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("rows")), "logits")
    loss = seen.get["loss"]
    if loss is not None and not math.isfinite(loss):
        raise ValueError(f"the loss is {loss} at step {p.steps + 1}")
    weight_grads, input_grads = E.backward(f, top, c.layers, weights)
    c.progress.append({"step": p.steps + 1, "loss": loss, "nodes": seen.get["rows"]})
    return weight_grads, input_grads, loss or 0.0, f


def train_classes(labels: DataFrame, edges: DataFrame, p: Encoded, c: EncoderConfig, first_epoch: int = 0) -> Encoded:
    """Parameters after ``c.epochs`` passes over labelled nodes (id, y): a step for each batch."""
    for epoch in range(first_epoch, first_epoch + c.epochs):
        batches = materialize(E.node_batches(labels, c.batch_size, f"epoch{epoch}"), "batches")
        count = batches.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("n")).first()["n"]
        for b in range(count):
            weight_grads, input_grads, _, f = class_step_gradients(batches.where(F.col("batch_id") == b), edges, p, c)
            p = updated(p, c, weight_grads, input_grads)
            f.release()
        release(batches)
    return p


def classify(nodes: DataFrame, edges: DataFrame, p: Encoded, c: EncoderConfig) -> DataFrame:
    """(id, y_pred, y) of nodes (id, y): the class of the highest logit."""
    f, _ = c.run(nodes.select(F.col("id").alias("node")), edges, p)
    return predicted(f.output.select("id", F.col("g").alias("logits")).join(nodes.select("id", "y"), "id"))


def class_accuracy(nodes: DataFrame, edges: DataFrame, p: Encoded, c: EncoderConfig) -> DataFrame:
    return accuracy(classify(nodes, edges, p, c))


def link_step_gradients(batches: DataFrame, edges: DataFrame, p: Encoded, c: EncoderConfig, config: TrainConfig, total: int, salt: str) -> tuple[DataFrame, DataFrame, DataFrame, E.Forward]:
    """(weight gradients, input gradients, gradient rows of the kernels, forward tables) of link prediction over encoded nodes."""
    ends = batches.select(F.col("src").alias("node")).unionByName(batches.select(F.col("dst").alias("node")))
    for corrupt, _ in SIDES if config.inverse else SIDES[:1]:
        drawn = negatives(batches, total, config.negatives, config.degree_fraction, corrupt, config.filtered, salt if corrupt == "dst" else f"{salt}-{corrupt}")
        ends = ends.unionByName(drawn.select("node"))
    f, weights = c.run(ends.distinct(), edges, p)
    encoded = Parameters(f.output.select("id", F.col("g").alias("emb")), p.relations)
    rows = materialize(step_gradients(batches, edges, encoded, config, total, salt), "gradients")
    weight_grads, input_grads = E.backward(f, K.sum_gradients(rows, K.NODE, config.reduction), c.layers, weights)
    return weight_grads, input_grads, rows, f


def train_links(edges: DataFrame, known: DataFrame, p: Encoded, c: EncoderConfig, config: TrainConfig, first_epoch: int = 0) -> Encoded:
    """Parameters after ``config.epochs`` passes over the training edges; hops go over the ``known`` graph."""
    if config.method in ("GAN", "KBGAN"):
        raise ValueError("the generator has no encoder")
    total = p.inputs().agg((F.max("id") + 1).alias("n")).first()["n"]
    for epoch in range(first_epoch, first_epoch + config.epochs):
        batches = materialize(with_chunks(assign_batches(edges, F.col("edge"), config.batch_size, f"epoch{epoch}"), config.chunks), "batches")
        count = batches.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("n")).first()["n"]
        for b in range(0, count, config.batches_per_step):
            own = batches.where((F.col("batch_id") >= b) & (F.col("batch_id") < b + config.batches_per_step))
            weight_grads, input_grads, rows, f = link_step_gradients(own, known, p, c, config, total, f"epoch{epoch}")
            found = rows.where(F.col("kind") == K.TOTAL).agg(F.sum("loss").alias("loss"), F.sum("terms").alias("terms"), F.sum("pairs").alias("pairs")).first().asDict()
            if found["loss"] is not None and not math.isfinite(found["loss"]):
                raise ValueError(f"the loss is {found['loss']} at step {p.steps + 1}")
            config.progress.append({"step": p.steps + 1, "salt": f"epoch{epoch}", "gradient_bytes": None, "generator_loss": None} | found)
            relations = p.relations
            for side, (_, vector) in enumerate(SIDES if config.inverse else SIDES[:1]):
                relations = apply_gradients(relations, K.sum_gradients(rows.where(F.col("side") == side), K.RELATION, config.reduction), "rel", c.dense, p.steps + 1, vector)
            relations = materialize(relations, "relations")
            p = updated(p, c, weight_grads, input_grads)
            p.relations = relations
            f.release()
            release(rows)
        release(batches)
    return p
