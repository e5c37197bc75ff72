"""Chunk kernels: the positives of a chunk share its negatives, so their scores and gradients are matrix products.

A chunk travels to a task as narrow rows (its edges, its negatives, the pairs to leave out) and one row for each distinct
node and relation vector that it needs; no row of a pair ever holds a vector. A chunk has at most as many edges as a batch
has per chunk, and its negatives; with every node as a negative, the nodes are dealt to blocks of ``NODE_ROWS``.

The numpy functions below know decoders, losses and selections; :func:`chunk_scores` and :func:`chunk_gradients` run them
over all chunks of all batches given, in one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import ship, shuffle_partitions, sized_broadcast

#: Kinds of rows that make a chunk, and of gradient rows.
NODE, RELATION, EDGE, NEGATIVE, LEFT_OUT, GENERATOR, TOTAL = range(7)
LOSSES = ("SOFTMAX_CE", "CROSS_ENTROPY", "RANKING", "BCE_AFTER_SIGMOID", "BCE_WITH_LOGITS", "MSE", "SOFTPLUS")
METHODS = ("RNS", "DNS", "GAN", "KBGAN")
#: Sums of squares are kept at this or more, as in the distance decoder.
TINY = 1e-8


@dataclass(frozen=True)
class Step:
    """What is computed of a chunk: decoder, loss, and how its negatives are chosen."""

    decoder: str = "DISTMULT"
    loss: str = "SOFTMAX_CE"
    margin: float = 0.1
    method: str = "RNS"
    ratio: float = 1.0

    def __post_init__(self):
        if self.decoder not in ("DISTMULT", "COMPLEX", "TRANSE"):
            raise ValueError(f"no training by {self.decoder}")
        if self.loss not in LOSSES or self.method not in METHODS or not 0 < self.ratio <= 1:
            raise ValueError(f"no training by {self.loss}, {self.method}, {self.ratio}")

    def kept(self, negatives: int) -> int:
        """How many of a positive's negatives are chosen: a share, rounded down, one at least."""
        return max(1, int(negatives * self.ratio))


# Decoders.
def _complex(a: np.ndarray) -> np.ndarray:
    n = a.shape[1] // 2
    return a[:, :n] + 1j * a[:, n:]


def _real(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a.real, a.imag], 1)


def moved(decoder: str, e: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Kept ends after the relation."""
    if decoder == "DISTMULT":
        return e * r
    return _real(_complex(e) * _complex(r)) if decoder == "COMPLEX" else e + r


def unmoved(decoder: str, e: np.ndarray, r: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients in kept ends and relations from those in the moved ends."""
    if decoder == "DISTMULT":
        return g * r, g * e
    if decoder == "COMPLEX":
        return _real(np.conj(_complex(r)) * _complex(g)), _real(np.conj(_complex(e)) * _complex(g))
    return g, g


def row_scores(decoder: str, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    if decoder == "TRANSE":
        return np.sqrt(np.maximum(((x - t) ** 2).sum(1), TINY))
    return np.einsum("ij,ij->i", x, t)


def all_scores(decoder: str, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Every moved end against every negative."""
    if decoder == "TRANSE":
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (n * n).sum(1)[None] - 2 * x @ n.T, TINY))
    return x @ n.T


def row_back(decoder: str, x: np.ndarray, t: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients in x and t of scores with coefficients c."""
    if decoder == "TRANSE":
        g = (x - t) * np.where(s * s > TINY, c / s, 0.0)[:, None]
        return g, -g
    return c[:, None] * t, c[:, None] * x


def all_back(decoder: str, x: np.ndarray, n: np.ndarray, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients in x and n of all scores with coefficients c."""
    if decoder == "TRANSE":
        w = np.where(s * s > TINY, c / s, 0.0)
        return w.sum(1)[:, None] * x - w @ n, w.sum(0)[:, None] * n - w.T @ x
    return c @ n, c.T @ x


# Losses.
def _log_sum(pos: np.ndarray, neg: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Log of the sum of the exponentials of a positive's score and its valid negatives'."""
    s = np.where(valid, neg, -np.inf)
    top = np.maximum(pos, s.max(1, initial=-np.inf))
    return top + np.log(np.exp(pos - top) + np.exp(s - top[:, None]).sum(1))


def coefficients(step: Step, pos: np.ndarray, neg: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(of positives, of negatives, loss, terms): gradients of a summed loss in the scores, and what a mean divides by."""
    sigmoid = lambda s: 1 / (1 + np.exp(-s))
    soft = lambda s: np.maximum(s, 0) + np.log1p(np.exp(-np.abs(s)))  # noqa: E731  log(1 + exp(s))
    if step.loss in ("SOFTMAX_CE", "CROSS_ENTROPY"):
        lse = _log_sum(pos, neg, valid)
        return np.exp(pos - lse) - 1, np.where(valid, np.exp(np.where(valid, neg, 0) - lse[:, None]), 0.0), float((lse - pos).sum()), len(pos)
    if step.loss == "RANKING":
        over = np.where(valid, neg - pos[:, None] + step.margin, 0.0)
        hit = (over > 0) & valid
        return -hit.sum(1).astype(float), hit.astype(float), float(over[hit].sum()), int(valid.sum())
    terms = len(pos) + int(valid.sum())
    if step.loss == "MSE":
        return 2 * (pos - 1), np.where(valid, 2 * neg, 0.0), float(((pos - 1) ** 2).sum() + (neg[valid] ** 2).sum()), terms
    return sigmoid(pos) - 1, np.where(valid, sigmoid(neg), 0.0), float(soft(-pos).sum() + soft(neg[valid]).sum()), terms


def hardest(scores: np.ndarray, valid: np.ndarray, kept: int) -> np.ndarray:
    """The ``kept`` best-scored valid entries of each row; of equal ones those further left."""
    order = np.argsort(np.where(valid, -scores, np.inf), 1, kind="stable")[:, :kept]
    chosen = np.zeros_like(valid)
    np.put_along_axis(chosen, order, True, 1)
    return chosen & valid


def generator_coefficients(logits: np.ndarray, reward: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(coefficients, loss, terms) of -sum(log p * reward * p), p the softmax over a row's valid logits; terms for its mean."""
    s = np.where(valid, logits, -np.inf)
    top = s.max(1, initial=-np.inf, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    z = np.exp(s - top)
    total = z.sum(1, keepdims=True)
    p = z / np.where(total > 0, total, 1)
    log_p = np.where(valid, logits - top - np.log(np.where(total > 0, total, 1)), 0.0)
    a = np.where(valid, reward * (1 + log_p), 0.0)
    return -p * (a - (p * a).sum(1, keepdims=True)), float(-(p * reward * log_p)[valid].sum()), int(valid.sum())


def add_rows(count: int, parts: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """(count, width) sums of rows by place; parts are (places, rows)."""
    at, rows = np.concatenate([p for p, _ in parts]), np.concatenate([r for _, r in parts])
    out = np.zeros((count, width))
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
        out[at[order][first]] = np.add.reduceat(rows[order], first)
    return out


@dataclass
class Result:
    """Gradients by place in the given matrices, the loss and its terms, the same of the generator, and pairs used."""

    nodes: np.ndarray
    relations: np.ndarray
    loss: float
    terms: int
    pairs: int
    generator: np.ndarray | None = None
    generator_loss: float = 0.0
    generator_terms: int = 0


def valid_pairs(kept: np.ndarray, other: np.ndarray, negatives: np.ndarray, left_out: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which (edge, negative) pairs count: not the true end, and none of the pairs (edge places, negative places) left out."""
    valid = other[:, None] != negatives[None]
    if left_out is not None:
        valid[left_out] = False
    return valid


def run_step(step: Step, x: np.ndarray, r: np.ndarray, kept: np.ndarray, rel: np.ndarray, other: np.ndarray, negatives: np.ndarray, valid: np.ndarray, own: np.ndarray | None = None) -> Result:
    """One chunk. ``kept``, ``other`` and ``negatives`` are places in the node matrix ``x``, ``rel`` in ``r``; ``own`` is the
    generator's node matrix. Negatives are in order of their ids, which breaks ties."""
    e, q, t, n = x[kept], r[rel], x[other], x[negatives]
    m = moved(step.decoder, e, q)
    pos, neg = row_scores(step.decoder, m, t), all_scores(step.decoder, m, n)
    chosen, extra = valid, {}
    if step.method == "DNS":
        chosen = hardest(neg, valid, step.kept(len(negatives)))
    elif step.method in ("GAN", "KBGAN"):
        a, b = own[kept], own[negatives]
        logits = a @ b.T
        chosen = hardest(logits, valid, step.kept(len(negatives)))
        c, loss, terms = generator_coefficients(logits, 2 * (1 / (1 + np.exp(-neg)) - 0.5), valid)
        extra = {"generator": add_rows(len(x), [(kept, c @ b), (negatives, c.T @ a)], x.shape[1]), "generator_loss": loss, "generator_terms": terms}
    cp, cn, loss, terms = coefficients(step, pos, neg, chosen)
    gm, gt = row_back(step.decoder, m, t, pos, cp)
    gm2, gn = all_back(step.decoder, m, n, neg, cn)
    ge, gr = unmoved(step.decoder, e, q, gm + gm2)
    width = x.shape[1]
    return Result(add_rows(len(x), [(kept, ge), (other, gt), (negatives, gn)], width), add_rows(len(r), [(rel, gr)], width), loss, terms, len(pos) + int(chosen.sum()), **extra)


# Rows.
def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of batches whose rows have equal keys (longs)."""
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(1 + np.flatnonzero((k[1:] != k[:-1]).any(1))), len(k)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield tuple(k[s].tolist()), b.slice(s, e - s)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal keys, over the borders of batches."""
    held, current = [], None
    for key, b in pieces(batches, keys):
        if held and key != current:
            yield current, pa.Table.from_batches(held)
            held = []
        current = key
        held.append(b)
    if held:
        yield current, pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vectors(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(m.shape[1], 1), dtype=np.int32)[: len(m) + 1]), pa.array(np.ascontiguousarray(m).ravel()))


#: Rows of a chunk: what kind, ids, and vectors of nodes and relations.
ROWS = "batch_id long, chunk_id long, kind long, edge long, id long, rel long, other long, vec array<double>, own array<double>"


def chunk_rows(batches: DataFrame, drawn: DataFrame, nodes: DataFrame, relations: DataFrame, corrupt: str = "dst", vector: str = "emb", left_out: DataFrame | None = None, generator: DataFrame | None = None) -> DataFrame:
    """All rows of all chunks, chunk by chunk. batches: (edge, batch_id, chunk_id, src, rel, dst); drawn: (batch_id, chunk_id,
    node); left_out: (edge, node), of one batch where it has a batch_id; ``vector`` names the relations' column; generator: (id, emb)."""
    keep = "src" if corrupt == "dst" else "dst"
    keys = ["batch_id", "chunk_id"]
    edges = batches.select(*keys, "edge", F.col(keep).alias("id"), "rel", F.col(corrupt).alias("other"))
    negatives = drawn.select(*keys, F.col("node").alias("id")).distinct()
    wanted = edges.select(*keys, "id").unionByName(edges.select(*keys, F.col("other").alias("id"))).unionByName(negatives).distinct()
    width = 8 * 64 + 32
    tables = nodes.select("id", F.col("emb").alias("vec"))
    if generator is not None:
        tables = tables.join(generator.select("id", F.col("emb").alias("own")), "id")
    found = wanted.join(sized_broadcast(tables, 2 * width), "id")
    rels = edges.select(*keys, "rel").distinct().join(sized_broadcast(relations.select("rel", F.col(vector).alias("vec")), width), "rel")
    parts = [found.withColumn("kind", F.lit(NODE)), rels.withColumn("kind", F.lit(RELATION)), edges.withColumn("kind", F.lit(EDGE)), negatives.withColumn("kind", F.lit(NEGATIVE))]
    if left_out is not None:
        by = [c for c in ("edge", "batch_id") if c in left_out.columns]
        parts.append(edges.select(*keys, "edge").join(left_out.select(*by, F.col("node").alias("id")).distinct(), by).withColumn("kind", F.lit(LEFT_OUT)))
    names = {f.split()[0]: f.split()[1] for f in ROWS.split(", ")}
    every = None
    for p in parts:
        # Rows without a vector carry an empty one: Arrow's writers take time with the square of a stretch of null lists.
        p = p.select(*[(F.col(c) if c in p.columns else F.lit(None) if t == "long" else F.array()).cast("bigint" if t == "long" else t).alias(c) for c, t in names.items()])
        every = p if every is None else every.unionByName(p)
    return every.repartition(shuffle_partitions(batches.sparkSession), *keys).sortWithinPartitions(*keys, "kind", "edge", "id", "rel")


@dataclass
class Chunk:
    """A chunk's matrices and the places of its edges' ends, relations and negatives in them."""

    ids: np.ndarray
    rels: np.ndarray
    x: np.ndarray
    r: np.ndarray
    own: np.ndarray | None
    edges: np.ndarray
    kept: np.ndarray
    rel: np.ndarray
    other: np.ndarray
    negatives: np.ndarray
    valid: np.ndarray


def read_chunk(t: pa.Table) -> Chunk | None:
    """A chunk from its sorted rows; None if it has no edges whose ends and relations are all known."""
    kind = t.column("kind").to_numpy()
    bounds = np.searchsorted(kind, np.arange(LEFT_OUT + 2))
    part = lambda k: t.slice(bounds[k], bounds[k + 1] - bounds[k])
    column = lambda p, c: p.column(c).to_numpy() if p.num_rows else np.zeros(0, np.int64)
    nodes, rels, edges, negs, out = (part(k) for k in (NODE, RELATION, EDGE, NEGATIVE, LEFT_OUT))
    ids, names = column(nodes, "id"), column(rels, "rel")
    kept, other, rel = column(edges, "id"), column(edges, "other"), column(edges, "rel")
    known = np.isin(kept, ids) & np.isin(other, ids) & np.isin(rel, names)
    edge, kept, other, rel = column(edges, "edge")[known], kept[known], other[known], rel[known]
    if not len(edge):
        return None
    neg = column(negs, "id")
    neg = neg[np.isin(neg, ids)]
    left = None
    if out.num_rows:
        e, n = column(out, "edge"), column(out, "id")
        ok = np.isin(e, edge) & np.isin(n, neg)
        left = np.searchsorted(edge, e[ok]), np.searchsorted(neg, n[ok])
    own = matrix(nodes.column("own")) if pc.any(pc.greater(pc.list_value_length(nodes.column("own")), 0)).as_py() else None
    place = lambda v: np.searchsorted(ids, v)
    return Chunk(ids, names, matrix(nodes.column("vec")), matrix(rels.column("vec")), own, edge, place(kept), np.searchsorted(names, rel), place(other), place(neg), valid_pairs(kept, other, neg, left))


def chunk_scores(rows: DataFrame, decoder: str = "DISTMULT") -> DataFrame:
    """(edge, src, rel, node, label, score) of all positives and their valid negatives; rows: :func:`chunk_rows`."""
    ship(rows.sparkSession)
    names = ["edge", "src", "rel", "node", "label", "score"]

    def run(batches):
        for _, table in groups(batches, ["batch_id", "chunk_id"]):
            c = read_chunk(table)
            if c is None:
                continue
            m = moved(decoder, c.x[c.kept], c.r[c.rel])
            scores = [row_scores(decoder, m, c.x[c.other])[:, None], all_scores(decoder, m, c.x[c.negatives])]
            used = np.concatenate([np.ones((len(m), 1), bool), c.valid], 1)
            row, col = np.nonzero(used)
            ends = np.concatenate([c.ids[c.other][:, None], np.broadcast_to(c.ids[c.negatives], c.valid.shape)], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (c.edges[row], c.ids[c.kept][row], c.rels[c.rel][row], ends[row, col], (col == 0).astype(np.int32), np.concatenate(scores, 1)[row, col])], names=names
            )

    return rows.mapInArrow(run, "edge long, src long, rel long, node long, label int, score double")


def chunk_ranks(rows: DataFrame, operator: str, comparator: str, negate: bool = False, digits: int = 9) -> DataFrame:
    """(edge, rank) of all edges: one more than the valid negatives of its chunk that score at least as high; scores are rounded."""
    ship(rows.sparkSession)
    decoder = {"hadamard": "DISTMULT", "complex_hadamard": "COMPLEX", "translation": "TRANSE"}[operator]
    if (comparator == "l2") is not (decoder == "TRANSE") or comparator not in ("dot", "l2"):
        raise ValueError(f"no blocks for {operator} with {comparator}")

    def run(batches):
        for _, table in groups(batches, ["batch_id", "chunk_id"]):
            c = read_chunk(table)
            if c is None:
                continue
            m = moved(decoder, c.x[c.kept], c.r[c.rel])
            pos, neg = row_scores(decoder, m, c.x[c.other]), all_scores(decoder, m, c.x[c.negatives])
            sign = -1 if negate else 1
            rank = 1 + ((np.round(sign * neg, digits) >= np.round(sign * pos, digits)[:, None]) & c.valid).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(c.edges), pa.array(rank)], names=["edge", "rank"])

    return rows.mapInArrow(run, "edge long, rank long")


#: Gradient rows: sums of a task's chunks for (kind, batch, id), and rows of kind TOTAL with a chunk's loss, terms and pairs.
GRADIENTS = "kind long, batch_id long, id long, g array<double>, loss double, terms long, pairs long"
#: Rows of sums that a task holds before it passes them on.
HELD = 1 << 16


def chunk_gradients(rows: DataFrame, step: Step) -> DataFrame:
    """Gradient rows (kind, batch_id, id, g, loss, terms, pairs) of summed losses, added up for each task as far as it holds them.

    Kinds: NODE, RELATION, GENERATOR, and TOTAL (id: the chunk) without a vector; a TOTAL row with id -1 - chunk is the generator's.
    """
    ship(rows.sparkSession)

    def run(batches):
        held, size, batch = {}, 0, None

        def flush():
            for kind, parts in held.items():
                ids, places = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
                sums = add_rows(len(ids), [(places, np.concatenate([g for _, g in parts]))], parts[0][1].shape[1])
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, kind)), pa.array(np.full(n, batch)), pa.array(ids), vectors(sums), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
                    names=["kind", "batch_id", "id", "g", "loss", "terms", "pairs"],
                )

        for (b, chunk), table in groups(batches, ["batch_id", "chunk_id"]):
            c = read_chunk(table)
            if c is None:
                continue
            if held and (b != batch or size > HELD):
                yield from flush()
                held, size = {}, 0
            batch = b
            found = run_step(step, c.x, c.r, c.kept, c.rel, c.other, c.negatives, c.valid, c.own)
            held.setdefault(NODE, []).append((c.ids, found.nodes))
            held.setdefault(RELATION, []).append((c.rels, found.relations))
            totals = [(chunk, found.loss, found.terms, found.pairs)]
            if found.generator is not None:
                own = np.union1d(c.kept, c.negatives)
                held.setdefault(GENERATOR, []).append((c.ids[own], found.generator[own]))
                totals.append((-1 - chunk, found.generator_loss, found.generator_terms, found.generator_terms))
            size += len(c.ids) + len(c.rels)
            ids, losses, terms, pairs = zip(*totals, strict=True)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([TOTAL] * n), pa.array([b] * n), pa.array(ids), pa.nulls(n, pa.list_(pa.float64())), pa.array(losses, pa.float64()), pa.array(terms, pa.int64()), pa.array(pairs, pa.int64())],
                names=["kind", "batch_id", "id", "g", "loss", "terms", "pairs"],
            )
        if held:
            yield from flush()

    return rows.mapInArrow(run, GRADIENTS)


def sum_gradients(rows: DataFrame, kind: int, reduction: str = "SUM") -> DataFrame:
    """(id, g) of one kind over all batches given, each batch's loss reduced on its own. ``rows`` should be a written table."""
    ship(rows.sparkSession)
    own = rows.where(F.col("kind") == kind).select("id", "batch_id", "g")
    if reduction.upper() == "MEAN":
        side = F.col("id") < 0 if kind == GENERATOR else F.col("id") >= 0
        terms = rows.where((F.col("kind") == TOTAL) & side).groupBy("batch_id").agg(F.sum("terms").alias("n"))
        own = own.join(F.broadcast(terms), "batch_id").select("id", F.transform("g", lambda x: x / F.greatest(F.col("n"), F.lit(1))).alias("g"))
    elif reduction.upper() != "SUM":
        raise ValueError(f"unknown reduction {reduction}")
    return add_vectors(own.select("id", "g"))


def add_vectors(rows: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(id, g): sums of vectors of one length by id, or other long keys; rows are sorted inside partitions, by vector where keys are
    equal, so that reruns add in the same order, and added block by block."""
    ship(rows.sparkSession)

    def out(names, sums):
        return pa.RecordBatch.from_arrays([*[pa.array(c) for c in names.T], vectors(sums)], names=[*keys, "g"])

    def run(batches):
        last, total = None, None
        for b in batches:
            if not b.num_rows:
                continue
            own, m = np.stack([b.column(c).to_numpy() for c in keys], 1), matrix(pa.chunked_array([b.column("g")]))
            first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]).any(1)])
            names, sums = own[first], np.add.reduceat(m, first)
            if last is not None and (names[0] == last).all():
                sums[0] += total
            elif last is not None:
                names, sums = np.concatenate([last[None], names]), np.concatenate([total[None], sums])
            last, total = names[-1], sums[-1]
            if len(names) > 1:
                yield out(names[:-1], sums[:-1])
        if last is not None:
            yield out(last[None], total[None])

    ordered = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "g")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", g array<double>")
