"""Edge decoders: joins that bring embeddings together and expressions that score them, and block scoring by matrices."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import vectors as V
from graphloom.functions.losses import log_sum
from graphloom.runtime import shuffle_partitions, ship


@dataclass(frozen=True)
class Decoder:
    """A relation operator, a comparator and the value relations start from."""

    operator: str
    comparator: str
    initial: str
    negate: bool = False

    def apply(self, e: Column, r: Column) -> Column:
        return V.OPERATORS[self.operator](e, r)

    def compare(self, a: Column, b: Column) -> Column:
        s = V.COMPARATORS[self.comparator](a, b)
        return -s if self.negate else s

    def score(self, e: Column, r: Column, other: Column) -> Column:
        return self.compare(self.apply(e, r), other)


DECODERS = {"DISTMULT": Decoder("hadamard", "dot", "ONES"), "TRANSE": Decoder("translation", "l2", "ZEROS"), "COMPLEX": Decoder("complex_hadamard", "dot", "REAL_ONE"), "COSINE": Decoder("hadamard", "cosine", "ONES")}


def get_decoder(name: str, negate: bool = False) -> Decoder:
    try:
        d = DECODERS[name.upper()]
    except KeyError:
        raise ValueError(f"unknown decoder {name}") from None
    return Decoder(d.operator, d.comparator, d.initial, negate)


def with_embeddings(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges with src_emb, dst_emb, rel_emb and rel_inv; the relation table is joined last and is usually small."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("emb").alias(f"{c}_emb"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").join(relations.select("rel", F.col("emb").alias("rel_emb"), F.col("inv_emb").alias("rel_inv")), "rel")


def score_positives(embedded: DataFrame, decoder: Decoder, inverse: bool = False) -> DataFrame:
    """Edges with score and, for the inverse direction, inv_score."""
    out = embedded.withColumn("score", decoder.score(F.col("src_emb"), F.col("rel_emb"), F.col("dst_emb")))
    return out.withColumn("inv_score", decoder.score(F.col("dst_emb"), F.col("rel_inv"), F.col("src_emb"))) if inverse else out


def score_pairs(pairs: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: Decoder, corrupt: str = "dst") -> DataFrame:
    """(edge, node, score) of given replacements: pairs have (edge, src, rel, dst, node)."""
    keep = "src" if corrupt == "dst" else "dst"
    base = pairs.join(nodes.select(F.col("id").alias(keep), F.col("emb").alias("_e")), keep).join(nodes.select(F.col("id").alias("node"), F.col("emb").alias("_n")), "node")
    base = base.join(relations.select("rel", F.col("emb" if corrupt == "dst" else "inv_emb").alias("_r")), "rel")
    return base.withColumn("score", decoder.score(F.col("_e"), F.col("_r"), F.col("_n"))).select("edge", "node", "score")


#: Relations of a block, and edges scored at a time.
RELATION_BLOCK, SCORED = 1024, 512


def score_relations(edges: DataFrame, nodes: DataFrame, relations: DataFrame, decoder: Decoder) -> DataFrame:
    """(edge, other_rel, score): every relation in place of an edge's own.

    Relations travel in blocks of ``RELATION_BLOCK`` packed rows; every edge meets each block by an equality join on the
    block's number, of which a task holds one at a time, and is scored by matrix products.
    """
    spark = edges.sparkSession
    ship(spark)
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("emb").alias(f"{c}_emb"))
    blocks = max(1, -(-relations.count() // RELATION_BLOCK))
    packed = relations.select("rel", "emb", F.pmod(F.xxhash64("rel"), F.lit(blocks)).alias("block")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("rel", "emb"))).alias("rels"))
    embedded = edges.select("edge", "src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("edge", "src_emb", "dst_emb")
    visits = embedded.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    rows = packed.select("block", F.lit(0).alias("kind"), "rels", null("edge", "bigint"), null("src_emb", "array<double>"), null("dst_emb", "array<double>"))
    rows = rows.unionByName(visits.select("block", F.lit(1).alias("kind"), null("rels", packed.schema["rels"].dataType), "edge", "src_emb", "dst_emb"))
    if blocks == 1:  # one small block: every task gets it, and edges stay where they are
        every = packed.select("rels")
        rels = every.first()
        names, vectors = (np.array([r["rel"] for r in rels["rels"]], np.int64), np.array([r["emb"] for r in rels["rels"]], float)) if rels else (np.zeros(0, np.int64), np.zeros((0, 1)))
        source, fixed = embedded, (names, vectors)
    else:
        source, fixed = rows.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "kind"), None
    operator, comparator, sign = decoder.operator, decoder.comparator, -1.0 if decoder.negate else 1.0
    out = pa.schema([("edge", pa.int64()), ("other_rel", pa.int64()), ("score", pa.float64())])

    def scored(edge, e, t, names, r):
        for i in range(0, len(edge), SCORED):
            a, b = e[i : i + SCORED], t[i : i + SCORED]
            n, m = len(a), len(names)
            s = _relation_scores(operator, comparator, a, b, r) * sign
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(edge[i : i + n], m)), pa.array(np.tile(names, n)), pa.array(s.ravel())], schema=out)

    def run(batches):
        names, r = fixed or (None, None)
        rows_of = lambda c: np.stack([np.asarray(v, float) for v in c.to_pylist()]) if len(c) else np.zeros((0, 1))
        for b in batches:
            if fixed is not None:
                yield from scored(b.column("edge").to_numpy(), rows_of(b.column("src_emb")), rows_of(b.column("dst_emb")), names, r)
                continue
            kinds = b.column("kind").to_numpy()
            cuts = [0, *(1 + np.flatnonzero(np.diff(kinds))), *np.flatnonzero(kinds == 0), len(kinds)]
            cuts = sorted(set(cuts))
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = b.slice(s, e - s)
                if kinds[s] == 0:
                    block = part.column("rels").to_pylist()[-1]
                    names, r = np.array([x["rel"] for x in block], np.int64), np.array([x["emb"] for x in block], float)
                else:
                    yield from scored(part.column("edge").to_numpy(), rows_of(part.column("src_emb")), rows_of(part.column("dst_emb")), names, r)

    return source.mapInArrow(run, "edge long, other_rel long, score double")


def _relation_scores(operator: str, comparator: str, e: np.ndarray, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Scores of every edge (its ends in rows) under every relation."""
    if comparator in ("dot", "cosine_compat") and operator == "hadamard":
        return (e * t) @ r.T
    if comparator == "dot" and operator == "complex_hadamard":
        n = e.shape[1] // 2
        a, b = e[:, :n] + 1j * e[:, n:], t[:, :n] + 1j * t[:, n:]
        return np.real((a * np.conj(b)) @ (r[:, :n] + 1j * r[:, n:]).T)
    if comparator == "l2" and operator == "translation":
        d = e - t
        return np.sqrt(np.maximum((d * d).sum(1)[:, None] + (r * r).sum(1)[None] + 2 * d @ r.T, 1e-8))
    if comparator == "cosine" and operator == "hadamard":
        norms = np.sqrt((e * e) @ (r * r).T) * np.sqrt((t * t).sum(1))[:, None]
        return np.where(norms > 0, (e * t) @ r.T / np.where(norms > 0, norms, 1), 0.0)
    raise ValueError(f"no blocks for {operator} with {comparator}")


def rewards(score: Column) -> Column:
    """2 (sigmoid(score) - 0.5)."""
    return 2 * (1 / (1 + F.exp(-score)) - 0.5)


def generator_loss(scored: DataFrame) -> DataFrame:
    """-mean(log softmax * reward * softmax) over an edge's negatives; rows (edge, node, score, reward)."""
    top = scored.groupBy("edge").agg(F.max("score").alias("top"))
    both = scored.join(top, "edge")
    lse = both.groupBy("edge").agg((F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("lse"))
    each = scored.join(lse, "edge").withColumn("lp", F.col("score") - F.col("lse"))
    return each.agg((-F.avg(F.col("lp") * F.col("reward") * F.exp("lp"))).alias("loss"))


def packed_generator_loss(packed: DataFrame) -> DataFrame:
    """The same over rows (scores, rewards): the negatives of one edge."""
    lse = log_sum(F.col("scores"))
    pairs = F.zip_with("scores", "rewards", lambda s, w: (s - F.col("lse")) * w * F.exp(s - F.col("lse")))
    rows = packed.select("scores", "rewards", lse.alias("lse")).select(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x).alias("l"), F.size("scores").alias("n"))
    return rows.agg((-F.sum("l") / F.sum("n")).alias("loss"))


def relation_norm(relations: DataFrame) -> DataFrame:
    return relations.agg(F.avg(V.norm(F.col("emb"))).alias("mean_norm"))
