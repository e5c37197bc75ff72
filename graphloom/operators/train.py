"""Training: closed-form gradients, optimisers with saved state, epochs of data-parallel steps, rounds over partitions.

Pair forms (:func:`pair_scores`, :func:`gradients`) take explicit pairs; training itself uses the chunk kernels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.hashing import h48
from graphloom.operators import grid as R
from graphloom.operators import kernels as K
from graphloom.operators.batches import assign_batches, global_collisions, negatives, with_chunks
from graphloom.operators.scoring import get_decoder
from graphloom.operators.sums import reduce_vectors, vector_width
from graphloom.runtime import materialize, release, shuffle_partitions, ship, sized_broadcast


def sgd(p: Column, g: Column, lr: float) -> Column:
    return V.subtract(p, V.scale(g, F.lit(lr)))


def adagrad(g: Column, state: Column, lr: float, eps: float = 1e-10) -> tuple[Column, Column]:
    """(delta of the parameter, delta of the state)."""
    ds = V.multiply(g, g)
    new = V.add(state, ds)
    return F.zip_with(g, new, lambda a, s: -F.lit(lr) * a / (F.sqrt(s) + F.lit(eps))), ds


def dense_adagrad(p: Column, g: Column, state: Column, lr: float, step: int, lr_decay: float = 0.0, weight_decay: float = 0.0, eps: float = 1e-10) -> tuple[Column, Column]:
    """(parameter, state) after a step with optional weight decay and decaying rate."""
    g = V.add(g, V.scale(p, F.lit(weight_decay))) if weight_decay else g
    delta, ds = adagrad(g, state, lr / (1 + (step - 1) * lr_decay), eps)
    return V.add(p, delta), V.add(state, ds)


def adam(p: Column, g: Column, m: Column, v: Column, step: int, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, weight_decay: float = 0.0, vmax: Column | None = None) -> tuple[Column, ...]:
    """(parameter, m, v[, vmax]) after a bias-corrected step; with ``vmax`` the amsgrad form."""
    g = V.add(g, V.scale(p, F.lit(weight_decay))) if weight_decay else g
    m = F.zip_with(m, g, lambda a, x: F.lit(b1) * a + F.lit(1 - b1) * x)
    v = F.zip_with(v, g, lambda a, x: F.lit(b2) * a + F.lit(1 - b2) * x * x)
    top = v if vmax is None else F.zip_with(vmax, v, lambda a, b: F.greatest(a, b))
    denominator = F.transform(top, lambda x: F.sqrt(x) / F.sqrt(F.lit(1 - b2**step)) + F.lit(eps))
    new = F.zip_with(p, F.zip_with(m, denominator, lambda a, b: a / b), lambda a, b: a - F.lit(lr / (1 - b1**step)) * b)
    return (new, m, v) if vmax is None else (new, m, v, top)


def softmax_coefficients(scores: DataFrame) -> DataFrame:
    """(edge, node, label, coef, loss): gradient of the summed softmax loss in each score."""
    top = scores.groupBy("edge").agg(F.max("score").alias("top"))
    each = scores.join(top, "edge")
    sums = each.groupBy("edge").agg((F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("lse"))
    each = scores.join(sums, "edge")
    return each.withColumn("coef", F.exp(F.col("score") - F.col("lse")) - F.col("label"))


LOSSES = ("SOFTMAX_CE", "CROSS_ENTROPY", "RANKING", "BCE_AFTER_SIGMOID", "BCE_WITH_LOGITS", "MSE", "SOFTPLUS")


def coefficients(scores: DataFrame, loss: str = "SOFTMAX_CE", reduction: str = "SUM", margin: float = 0.1) -> DataFrame:
    """(edge, node, label, score, coef): gradient of a reduced loss in each score."""
    loss, reduction = loss.upper(), reduction.upper()
    if loss not in LOSSES or reduction not in ("SUM", "MEAN"):
        raise ValueError(f"no training by {loss}, {reduction}")
    s, terms = F.col("score"), scores
    if loss in ("SOFTMAX_CE", "CROSS_ENTROPY"):
        out, terms = softmax_coefficients(scores), scores.select("edge").distinct()
    elif loss == "RANKING":
        terms = scores.where("label = 0")
        pos = scores.where("label = 1").select("edge", F.col("score").alias("pos"))
        each = scores.join(pos, "edge").withColumn("coef", ((F.col("label") == 0) & (s - F.col("pos") + F.lit(margin) > 0)).cast("double"))
        beaten = each.groupBy("edge").agg(F.sum("coef").alias("beaten"))
        out = each.join(beaten, "edge").withColumn("coef", F.when(F.col("label") == 1, -F.col("beaten")).otherwise(F.col("coef")))
    else:
        out = scores.withColumn("coef", 2 * (s - F.col("label")) if loss == "MSE" else 1 / (1 + F.exp(-s)) - F.col("label"))
    scale = F.lit(1.0 / max(terms.count(), 1)) if reduction == "MEAN" else F.lit(1.0)
    return out.select("edge", "node", "label", "score", (F.col("coef") * scale).alias("coef"))


def _conjugate(a: Column) -> Column:
    return F.concat(V.half(a, False), V.scale(V.half(a, True), F.lit(-1.0)))


def score_gradients(decoder: str, e: Column, r: Column, t: Column, score: Column) -> tuple[Column, Column, Column]:
    """Gradients of a decoder's score in its source, relation and target."""
    if decoder == "DISTMULT":
        return V.multiply(r, t), V.multiply(e, t), V.multiply(e, r)
    if decoder == "COMPLEX":
        return V.complex_hadamard(_conjugate(r), t), V.complex_hadamard(_conjugate(e), t), V.complex_hadamard(e, r)
    if decoder == "TRANSE":
        d = V.subtract(V.add(e, r), t)
        g = V.scale(d, F.when(V.dot(d, d) > 1e-8, 1 / score).otherwise(F.lit(0.0)))
        return g, g, V.scale(g, F.lit(-1.0))
    raise ValueError(f"no training by {decoder}")


def with_vectors(pairs: DataFrame, nodes: DataFrame, relations: DataFrame, vector: str = "emb") -> DataFrame:
    """Rows with src, rel and node, and their vectors e, r and t; tables of a checked size are broadcast."""
    width = 8 * vector_width(nodes) + 32
    nodes, rels = sized_broadcast(nodes.select("id", "emb"), width), sized_broadcast(relations.select("rel", F.col(vector).alias("r")), width)
    e = nodes.select(F.col("id").alias("src"), F.col("emb").alias("e"))
    t = nodes.select(F.col("id").alias("node"), F.col("emb").alias("t"))
    return pairs.join(e, "src").join(t, "node").join(rels, "rel")


def pair_scores(pairs: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str = "DISTMULT", vector: str = "emb") -> DataFrame:
    """Rows (edge, src, rel, node, label, score); ``vector`` names the relation's column."""
    score = get_decoder(decoder).score(F.col("e"), F.col("r"), F.col("t"))
    return with_vectors(pairs, nodes, relations, vector).select("edge", "src", "rel", "node", "label", score.alias("score"))


def distmult_scores(pairs: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows (edge, src, rel, node, label, score)."""
    return pair_scores(pairs, nodes, relations)


def _pair_gradients(scored: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: str, loss: str, reduction: str, margin: float, vector: str = "emb") -> tuple[DataFrame, DataFrame]:
    c = coefficients(scored.select("edge", "node", "label", "score"), loss, reduction, margin).select("edge", "node", "label", "coef")
    narrow = scored.join(c, ["edge", "node", "label"]).select("src", "rel", "node", "score", "coef")
    each = with_vectors(narrow, nodes, relations, vector)
    to_src, to_rel, to_dst = (V.scale(g, F.col("coef")).alias("g") for g in score_gradients(decoder, F.col("e"), F.col("r"), F.col("t"), F.col("score")))
    return each.select(F.col("src").alias("id"), to_src).unionByName(each.select(F.col("node").alias("id"), to_dst)), each.select("rel", to_rel)


def gradients(scored: DataFrame, node_table: DataFrame, relations: DataFrame, decoder: str = "DISTMULT", loss: str = "SOFTMAX_CE", reduction: str = "SUM", margin: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(node gradients (id, g), relation gradients (rel, g)) of a loss of the decoder's scores, by default the summed softmax.

    Coefficients are joined to the scored pairs (no vectors among them), then the vectors are looked up, each pair gives its three products, and one partial aggregation with a
    buffer for each element sums them; nothing is collected.
    """
    nodes, rels = _pair_gradients(scored, node_table, relations, decoder, loss, reduction, margin)
    width = vector_width(node_table)
    return sum_vectors(nodes, "id", width), sum_vectors(rels, "rel", width)


def sum_vectors(rows: DataFrame, key: str, width: int | None = None) -> DataFrame:
    """(key, g): sums of vectors."""
    return reduce_vectors(rows, key, "g", "g", width=width)


#: Replaced end, and the relation vector that scores it.
SIDES = (("dst", "emb"), ("src", "inv_emb"))


@dataclass(frozen=True)
class Optim:
    """An optimiser. Its state lies beside each parameter, in a column for each slot, and is saved with it."""

    type: str = "ADAGRAD"
    lr: float = 0.1
    eps: float | None = None
    weight_decay: float = 0.0
    lr_decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    amsgrad: bool = False

    def slots(self, parameter: str) -> dict[str, str]:
        """Slot -> column of a parameter; those of inv_emb begin with inv_."""
        prefix = parameter.removesuffix("emb")
        names = {"SGD": (), "ADAGRAD": ("state",), "ADAM": ("m", "v", "vmax") if self.amsgrad else ("m", "v")}
        if self.type not in names:
            raise ValueError(f"unknown optimizer {self.type}")
        return {n: prefix + n for n in names[self.type]}

    def update(self, p: Column, g: Column, state: dict[str, Column], step: int) -> tuple[Column, dict[str, Column]]:
        """(parameter, slots) after the step numbered ``step``, from 1."""
        if self.type == "SGD":
            return sgd(p, V.add(g, V.scale(p, F.lit(self.weight_decay))) if self.weight_decay else g, self.lr), {}
        if self.type == "ADAGRAD":
            new, s = dense_adagrad(p, g, state["state"], self.lr, step, self.lr_decay, self.weight_decay, 1e-10 if self.eps is None else self.eps)
            return new, {"state": s}
        new, *rest = adam(p, g, state["m"], state["v"], step, self.lr, *self.betas, 1e-8 if self.eps is None else self.eps, self.weight_decay, state.get("vmax"))
        return new, dict(zip(state, rest, strict=True))


def apply_gradients(table: DataFrame, grads: DataFrame, key: str, optim: Optim, step: int, parameter: str = "emb") -> DataFrame:
    """The table after one sparse step of a parameter; rows without a gradient stay, missing slots begin as zeros."""
    slots = optim.slots(parameter)
    for c in slots.values():
        if c not in table.columns:
            table = table.withColumn(c, F.transform(parameter, lambda x: F.lit(0.0)))
    joined, has = table.join(grads.select(F.col(grads.columns[0]).alias(key), F.col("g").alias("_g")), key, "left"), F.col("_g").isNotNull()
    new, state = optim.update(F.col(parameter), F.col("_g"), {s: F.col(c) for s, c in slots.items()}, step)
    changed = {parameter: new} | {slots[s]: v for s, v in state.items()}
    return joined.select(*[F.when(has, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])


def apply_adagrad(table: DataFrame, grads: DataFrame, key: str, lr: float, emb: str = "emb") -> DataFrame:
    """The table (key, emb, state) after one sparse step of Adagrad."""
    return apply_gradients(table, grads, key, Optim("ADAGRAD", lr), 1, emb)


@dataclass
class TrainConfig:
    """``batches_per_step`` batches are worked on side by side, and their gradients make one step."""

    epochs: int = 1
    batch_size: int = 10_000
    chunks: int = 1
    negatives: int = 100
    lr: float = 0.1
    relation_lr: float = 0.1
    decoder: str = "DISTMULT"
    loss: str = "SOFTMAX_CE"
    reduction: str = "SUM"
    margin: float = 0.1
    inverse: bool = True
    degree_fraction: float = 0.0
    filtered: bool = False
    method: str = "RNS"
    ratio: float = 1.0
    batches_per_step: int = 1
    sparse: Optim | None = None
    dense: Optim | None = None
    #: What every step reports: loss, terms, pairs, bytes of gradients.
    progress: list[dict] = field(default_factory=list)

    def step(self) -> K.Step:
        return K.Step(self.decoder, self.loss, self.margin, self.method, self.ratio)

    def optims(self) -> tuple[Optim, Optim]:
        return self.sparse or Optim(lr=self.lr), self.dense or Optim(lr=self.relation_lr)


def train_pairs(batches: DataFrame, drawn: DataFrame, corrupt: str = "dst") -> DataFrame:
    """(edge, src, rel, node, label): positives and the negatives of their chunk; false negatives among them are left out.

    For ``corrupt`` src the ends change places, so that src is the end that is kept.
    """
    if corrupt == "src":
        batches = batches.select("edge", "batch_id", "chunk_id", F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    pos = batches.select("edge", "src", "rel", F.col("dst").alias("node"), F.lit(1).alias("label"))
    neg = batches.select("edge", "batch_id", "chunk_id", "src", "rel", "dst").join(drawn.select("batch_id", "chunk_id", "node").distinct(), ["batch_id", "chunk_id"])
    return pos.unionByName(neg.where("node != dst").select("edge", "src", "rel", "node", F.lit(0).alias("label")))


@dataclass
class Parameters:
    """What training changes: node and relation tables, the generator's node table, and the steps taken so far."""

    nodes: DataFrame
    relations: DataFrame
    generator: DataFrame | None = None
    steps: int = 0

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "relations": self.relations} | ({"generator": self.generator} if self.generator is not None else {})


def step_gradients(batches: DataFrame, edges: DataFrame, p: Parameters, config: TrainConfig, total: int, salt: str) -> DataFrame:
    """Gradient rows of the kernels with ``side`` (0: targets replaced, 1: sources), over all batches given. Summed losses of
    many edges go over the grid, where a chunk may be of any size."""
    out = None
    wide = config.reduction == "SUM" and not config.filtered and config.negatives >= 0 and config.batch_size * config.batches_per_step > R.MANY and batches.count() > R.MANY
    for side, (corrupt, vector) in enumerate(SIDES if config.inverse else SIDES[:1]):
        drawn = negatives(batches, total, config.negatives, config.degree_fraction, corrupt, config.filtered, salt if corrupt == "dst" else f"{salt}-{corrupt}")
        generator = p.generator if config.method in ("GAN", "KBGAN") else None
        if wide and generator is None:
            own = batches if corrupt == "dst" else batches.withColumnsRenamed({"src": "dst", "dst": "src"})
            part = R.grid_gradients(own, drawn, p.nodes, p.relations, config.step(), vector)
        else:
            left_out = global_collisions(batches, edges, corrupt) if config.filtered else None
            part = K.chunk_gradients(K.chunk_rows(batches, drawn, p.nodes, p.relations, corrupt, vector, left_out, generator), config.step())
        part = part.withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


def train_step(batches: DataFrame, edges: DataFrame, p: Parameters, config: TrainConfig, total: int, salt: str) -> Parameters:
    """One step over all batches given: their gradients from the same parameters, added up, and one update."""
    sparse, dense = config.optims()
    seen, own = Observation(), F.col("kind") == K.TOTAL
    discriminator = own & (F.col("id") >= 0)
    rows = step_gradients(batches, edges, p, config, total, salt).observe(
        seen, F.sum(F.when(discriminator, F.col("loss"))).alias("loss"), F.sum(F.when(discriminator, F.col("terms"))).alias("terms"), F.sum(F.when(discriminator, F.col("pairs"))).alias("pairs"),
        F.sum(F.when(~own, F.size("g") * 8)).alias("gradient_bytes"), F.sum(F.when(own & (F.col("id") < 0), F.col("loss"))).alias("generator_loss"),
    )
    rows = materialize(rows, "gradients")
    found = seen.get
    if found["loss"] is not None and not math.isfinite(found["loss"]):
        raise ValueError(f"the loss is {found['loss']} at step {p.steps + 1}")
    config.progress.append({"step": p.steps + 1, "salt": salt} | found)
    t = p.steps + 1
    nodes = apply_gradients(p.nodes, K.sum_gradients(rows, K.NODE, config.reduction), "id", sparse, t)
    relations = p.relations
    for side, (_, vector) in enumerate(SIDES if config.inverse else SIDES[:1]):
        relations = apply_gradients(relations, K.sum_gradients(rows.where(F.col("side") == side), K.RELATION, config.reduction), "rel", dense, t, vector)
    new = Parameters(materialize(nodes, "nodes"), materialize(relations, "relations"), p.generator, t)
    if config.method in ("GAN", "KBGAN"):
        new.generator = materialize(apply_gradients(p.generator, K.sum_gradients(rows, K.GENERATOR, "MEAN"), "id", sparse, t), "generator")
    release(rows)
    return new


def train_parameters(edges: DataFrame, p: Parameters, config: TrainConfig, first_epoch: int = 0) -> Parameters:
    """``config.epochs`` passes: steps of ``batches_per_step`` batches follow each other, batches inside a step do not wait for one another."""
    if config.method in ("GAN", "KBGAN") and p.generator is None:
        raise ValueError("GAN training needs a generator table")
    given = {id(t) for t in p.tables().values()}
    total = p.nodes.agg((F.max("id") + 1).alias("n")).first()["n"]
    for epoch in range(first_epoch, first_epoch + config.epochs):
        batches = materialize(with_chunks(assign_batches(edges, F.col("edge"), config.batch_size, f"epoch{epoch}"), config.chunks), "batches")
        count = batches.agg(F.coalesce(F.max("batch_id") + 1, F.lit(0)).alias("n")).first()["n"]
        for b in range(0, count, config.batches_per_step):
            own = batches.where((F.col("batch_id") >= b) & (F.col("batch_id") < b + config.batches_per_step))
            new = train_step(own, edges, p, config, total, f"epoch{epoch}")
            for name, t in p.tables().items():
                if id(t) not in given and new.tables()[name] is not t:
                    release(t)
            p = new
        release(batches)
    return p


def train(edges: DataFrame, nodes: DataFrame, relations: DataFrame, config: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) after all epochs."""
    p = train_parameters(edges, Parameters(nodes, relations), config)
    return p.nodes, p.relations


def progress_report(spark, config: TrainConfig) -> DataFrame:
    """(step, epoch, loss, terms, pairs, gradient_bytes, generator_loss) of the steps taken with this configuration; their number is that of steps."""
    rows = [(r["step"], int(r["salt"].removeprefix("epoch").split("-")[0]), r["loss"], r["terms"], r["pairs"], r["gradient_bytes"], r["generator_loss"]) for r in config.progress]
    return spark.createDataFrame(rows, "step long, epoch long, loss double, terms long, pairs long, gradient_bytes long, generator_loss double")


# Rounds over partitions.
_ROUND = "state long, kind long, id long, rel long, other long, place long, emb array<double>, slot array<double>, inv array<double>, inv_slot array<double>"
_TRAINED = "state long, kind long, id long, emb array<double>, slot array<double>, inv array<double>, inv_slot array<double>, loss double, pairs long"
#: Edges of a round's batch whose vectors and gradients a task holds at a time.
TILE = 1 << 13


def _adagrad_rows(x: np.ndarray, s: np.ndarray, g: np.ndarray, optim: Optim) -> None:
    """A sparse step in place; rows whose gradient is zero everywhere stay."""
    at = np.flatnonzero(g.any(1))
    if optim.type == "SGD":
        x[at] -= optim.lr * g[at]
        return
    s[at] += g[at] ** 2
    x[at] -= optim.lr * g[at] / (np.sqrt(s[at]) + (1e-10 if optim.eps is None else optim.eps))


def draws(state: int, batch: int, chunk: int, count: int, resident: int, salt: str) -> np.ndarray:
    """Places of negatives among a state's nodes in id order: the same hash as elsewhere."""
    import hashlib

    return np.array([int(hashlib.md5(f"{state}-{batch}-{chunk}-{i}:{salt}".encode()).hexdigest()[:12], 16) % resident for i in range(count)], np.int64)


def train_round(edges: DataFrame, p: Parameters, states: list[list[int]], taken: set[tuple[int, int]], partition_size: int, config: TrainConfig, salt: str) -> Parameters:
    """One job: every state's nodes, relations and edges meet in one task, which takes a step for each of its batches.

    States share no partition, so no two tasks change a node. Edges of the state's buckets that no earlier round took come
    in hash order and stream through; negatives are drawn among the state's nodes. A relation's change is the mean of those
    of the states that changed it. A task holds the vectors of one state's partitions, the places of one batch of edges in them, and
    the gradients of ``TILE`` edges.
    """
    spark = edges.sparkSession
    ship(spark)
    sparse, dense = config.optims()
    if {sparse.type, dense.type} - {"ADAGRAD", "SGD"} or sparse.weight_decay or dense.weight_decay or config.method not in ("RNS", "DNS") or config.reduction != "SUM" or config.degree_fraction or config.filtered:
        raise ValueError("rounds over partitions know SGD and plain Adagrad, RNS and DNS, uniform negatives and summed losses")
    parts = [(int(q), k) for k, s in enumerate(states) for q in s]
    if len({q for q, _ in parts}) != len(parts):
        raise ValueError("the states of a round share no partition")
    buckets = [(a, b, k) for k, s in enumerate(states) for a in sorted(s) for b in sorted(s) if (a, b) not in taken]
    taken.update((a, b) for a, b, _ in buckets)
    part = lambda c: F.floor(F.col(c) / F.lit(partition_size)).cast("int")
    own = edges.withColumn("_a", part("src")).withColumn("_b", part("dst")).join(F.broadcast(spark.createDataFrame(buckets or [(-1, -1, -1)], "_a int, _b int, state long")), ["_a", "_b"])
    owners = F.broadcast(spark.createDataFrame(parts, "_a int, state long"))
    kinds = dict(f.split() for f in _ROUND.split(", "))
    # Rows without a vector carry an empty one: Arrow's writers take time with the square of a stretch of null lists.
    null = lambda *names: [(F.lit(None) if kinds[n] == "long" else F.array()).cast(kinds[n]).alias(n) for n in names]
    slot = lambda t, c, e: F.col(c) if c in t.columns else F.transform(e, lambda x: F.lit(0.0))
    n, r = p.nodes, p.relations
    renamed = n.withColumnRenamed("state", "slot") if "state" in n.columns else n.withColumn("slot", F.transform("emb", lambda x: F.lit(0.0)))
    node_rows = renamed.withColumn("_a", part("id")).join(owners, "_a").select("state", F.lit(K.NODE).cast("long").alias("kind"), "id", *null("rel", "other", "place"), "emb", "slot", *null("inv", "inv_slot"))
    rels = r.select("rel", "emb", slot(r, "state", "emb").alias("slot"), F.col("inv_emb").alias("inv"), slot(r, "inv_state", "inv_emb").alias("inv_slot"))
    used = own.select("state", "rel").distinct().join(sized_broadcast(rels, 4 * 8 * 64), "rel")
    rel_rows = used.select("state", F.lit(K.RELATION).cast("long").alias("kind"), F.col("rel").alias("id"), *null("rel", "other", "place"), "emb", "slot", "inv", "inv_slot")
    edge_rows = own.select("state", F.lit(K.EDGE).cast("long").alias("kind"), F.col("src").alias("id"), "rel", F.col("dst").alias("other"), h48(F.col("edge"), salt).alias("place"), *null("emb", "slot", "inv", "inv_slot"))
    rows = node_rows.unionByName(rel_rows).unionByName(edge_rows).repartition(max(shuffle_partitions(spark), 1), "state").sortWithinPartitions("state", "kind", "place", "id", "rel", "other")
    step, inverse, size, chunks, count = config.step(), config.inverse, config.batch_size, config.chunks, config.negatives

    def run(batches):
        state, tables, held, many, done, loss, pairs = None, {}, [], 0, 0, 0.0, 0

        def take(places: np.ndarray) -> None:
            nonlocal done, loss, pairs
            ids, x, sx = tables["ids"], tables["x"], tables["sx"]
            kept, rel, other = places.T
            width = -(-len(places) // chunks)
            gx, gr = np.zeros_like(x), [np.zeros_like(q) for q in tables["r"]]
            for c in range(0, len(places), width):
                for side in range(2 if inverse else 1):
                    neg = np.unique(draws(state, done, c // width, count, len(ids), salt if side == 0 else f"{salt}-src"))
                    for i in range(c, min(c + width, len(places)), TILE):
                        s = slice(i, min(i + TILE, c + width))
                        a, b = (kept[s], other[s]) if side == 0 else (other[s], kept[s])
                        used, at = np.unique(np.concatenate([a, b, neg]), return_inverse=True)
                        a, b, n = np.split(at, [len(a), 2 * len(a)])
                        found = K.run_step(step, x[used], tables["r"][side], a, rel[s], b, n, K.valid_pairs(a, b, n))
                        gx[used] += found.nodes
                        gr[side] += found.relations
                        loss, pairs = loss + found.loss, pairs + found.pairs
            _adagrad_rows(x, sx, gx, sparse)
            for side in range(2 if inverse else 1):
                _adagrad_rows(tables["r"][side], tables["sr"][side], gr[side], dense)
            done += 1

        def results():
            nulls = lambda k: pa.nulls(k, pa.list_(pa.float64()))
            names = ["state", "kind", "id", "emb", "slot", "inv", "inv_slot", "loss", "pairs"]
            for kind, ids, columns in ((K.NODE, tables["ids"], [K.vectors(tables["x"]), K.vectors(tables["sx"]), None, None]), (K.RELATION, tables["rels"], [K.vectors(m) for m in (tables["r"][0], tables["sr"][0], tables["r"][1], tables["sr"][1])])):
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([state] * k, pa.int64()), pa.array([kind] * k, pa.int64()), pa.array(ids), *[nulls(k) if c is None else c for c in columns], pa.nulls(k, pa.float64()), pa.nulls(k, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([state], pa.int64()), pa.array([K.TOTAL], pa.int64()), pa.array([done], pa.int64()), *[nulls(1)] * 4, pa.array([loss]), pa.array([pairs], pa.int64())], names=names)

        def load():
            """Node and relation matrices, from the rows that come before the state's edges."""
            read = lambda kind, c: K.matrix(pa.chunked_array([t.column(c) for t in found[kind]])).copy() if found[kind] else np.zeros((0, 0))
            ids = lambda kind: np.concatenate([t.column("id").to_numpy() for t in found[kind]]) if found[kind] else np.zeros(0, np.int64)
            tables.update({"ids": ids(K.NODE), "rels": ids(K.RELATION), "x": read(K.NODE, "emb"), "sx": read(K.NODE, "slot"), "r": [read(K.RELATION, c) for c in ("emb", "inv")], "sr": [read(K.RELATION, c) for c in ("slot", "inv_slot")]})

        def close():
            if not tables:
                load()
            if held:
                take(np.concatenate(held))
            yield from results()

        found = {}
        for (s, kind), t in K.pieces(batches, ["state", "kind"]):
            if s != state:
                if state is not None:
                    yield from close()
                state, held, many, done, loss, pairs, found = s, [], 0, 0, 0.0, 0, {K.NODE: [], K.RELATION: []}
                tables.clear()
            if kind != K.EDGE:
                found[kind].append(t)
                continue
            if not tables:
                load()
            places = [np.searchsorted(tables[by], t.column(c).to_numpy()) for c, by in (("id", "ids"), ("rel", "rels"), ("other", "ids"))]
            held.append(np.stack(places, 1).astype(np.int32))
            many += len(t)
            while many >= size:
                block = np.concatenate(held)
                held, many = [block[size:]] if many > size else [], many - size
                take(block[:size])
        if state is not None:
            yield from close()

    trained = materialize(rows.mapInArrow(run, _TRAINED), "round")
    totals = trained.where(F.col("kind") == K.TOTAL).agg(F.sum("loss").alias("loss"), F.sum("pairs").alias("pairs"), F.sum("id").alias("steps")).first()
    if totals["loss"] is not None and not math.isfinite(totals["loss"]):
        raise ValueError(f"the loss is {totals['loss']} in {salt}")
    config.progress.append({"step": p.steps + 1, "salt": salt, "loss": totals["loss"], "terms": None, "pairs": totals["pairs"], "gradient_bytes": None, "generator_loss": None})
    fresh = trained.where(F.col("kind") == K.NODE).select("id", F.col("emb").alias("_emb"), F.col("slot").alias("_slot"))
    nodes = renamed.withColumnRenamed("slot", "state").join(fresh, "id", "left")
    nodes = nodes.select(*[F.coalesce("_emb", "emb").alias("emb") if c == "emb" else F.coalesce("_slot", "state").alias("state") if c == "state" else c for c in renamed.withColumnRenamed("slot", "state").columns])
    moved = trained.where(F.col("kind") == K.RELATION).select(F.col("id").alias("rel"), *[F.col(c).alias(f"_{c}") for c in ("emb", "slot", "inv", "inv_slot")]).join(sized_broadcast(rels, 4 * 8 * 64), "rel")
    width = vector_width(rels)
    columns = {"emb": "emb", "slot": "state", "inv": "inv_emb", "inv_slot": "inv_state"}
    out = r.select("rel", *[c for c in r.columns if c not in (*columns.values(), "rel")]).join(rels.select("rel", *[F.col(c).alias(columns[c]) for c in columns]), "rel")
    for c, name in columns.items():
        change = reduce_vectors(moved.select("rel", V.subtract(F.col(f"_{c}"), F.col(c)).alias("d")), "rel", "d", "_d", F.avg, width)
        out = out.join(change, "rel", "left").withColumn(name, F.when(F.col("_d").isNull(), F.col(name)).otherwise(V.add(F.col(name), F.col("_d")))).drop("_d")
    new = Parameters(materialize(nodes, "nodes"), materialize(out, "relations"), p.generator, p.steps + int(totals["steps"] or 0))
    release(trained)
    return new


def train_rounds(edges: DataFrame, nodes: DataFrame, relations: DataFrame, rounds: list[list[list[int]]], partition_size: int, config: TrainConfig) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) after ``config.epochs`` passes by a cover schedule, one job for each round's training."""
    p = train_partitions(edges, Parameters(nodes, relations), rounds, partition_size, config)
    return p.nodes, p.relations


def train_partitions(edges: DataFrame, p: Parameters, rounds: list[list[list[int]]], partition_size: int, config: TrainConfig, first_epoch: int = 0) -> Parameters:
    given = {id(p.nodes), id(p.relations)}
    for epoch in range(first_epoch, first_epoch + config.epochs):
        taken: set[tuple[int, int]] = set()
        for k, states in enumerate(rounds):
            new = train_round(edges, p, states, taken, partition_size, config, f"epoch{epoch}-{k}")
            for t in (p.nodes, p.relations):
                if id(t) not in given:
                    release(t)
            p = new
    return p
