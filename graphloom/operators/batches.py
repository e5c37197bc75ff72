"""Batches, negatives and the filters of false negatives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.hashing import SPAN, h48
from graphloom.runtime import SMALL_BYTES, materialize, number_rows, release, sized_broadcast

#: Parts in which edges are made distinct and numbered, at most: one for each ``SMALL_BYTES`` of them up to that.
PARTS = 4


def assign_batches(edges: DataFrame, key: Column, size: int, salt: str = "batch") -> DataFrame:
    """Edges in hash order with batch_id and position; the last batch is smaller."""
    rows = number_rows(edges, [], "_row", keys={"_h": h48(key, salt), "_k": key})
    out = rows.withColumn("batch_id", F.floor(F.col("_row") / F.lit(size))).withColumn("position", F.col("_row") % F.lit(size)).drop("_row")
    out._scratch = rows._scratch
    return out


def written_batches(edges: DataFrame, rows: int, spread: Column, key: Column, size: int, chunks: int, salt: str = "batch") -> DataFrame:
    """The edges with batch_id and chunk_id as :func:`assign_batches` and :func:`with_chunks` give them, as a written table.

    ``edges``, from some ``rows`` rows, are written in parts of ``spread``, a long that may be computed before they are made distinct, and
    numbered in ranges of their hash, whose edges are deleted in turn: no shuffle, and no table beside the result, has all of them.
    """
    parts = max(1, min(PARTS, -(-rows * 16 // SMALL_BYTES)))
    ranged = edges.withColumn("_range", F.floor(h48(key, salt) * F.lit(parts) / F.lit(SPAN)).cast("int"))
    kept = materialize(*_split(ranged, spread, parts, "edges"), by="_range", codec="zstd")
    sizes = {r["_range"]: r["count"] for r in kept.groupBy("_range").count().collect()}
    total, start, out = sum(sizes.values()), 0, None
    for p in sorted(sizes, key=lambda x: (x is not None, x)) or [0]:
        numbered = number_rows(kept.where(F.col("_range").eqNullSafe(F.lit(p).cast("int"))).drop("_range"), [], "_row", start, keys={"_h": h48(key, salt), "_k": key})
        rows_of = numbered.withColumn("batch_id", F.floor(F.col("_row") / F.lit(size)))
        width = F.ceil(F.least(F.lit(size), F.lit(total) - F.col("batch_id") * F.lit(size)) / F.lit(chunks))
        rows_of = rows_of.withColumn("chunk_id", F.floor(F.col("_row") % F.lit(size) / width).cast("long")).drop("_row")
        if p is not None:
            release(kept, f"_range={p}")
        out = materialize(rows_of, "batches", onto=out, codec="zstd")
        release(numbered)
        start += sizes.get(p, 0)
    release(kept)
    return out


def written_edges(edges: DataFrame, rows: int, spread: Column) -> DataFrame:
    """The edges as a written table, made in the parts of :func:`written_batches`."""
    return materialize(*_split(edges, spread, max(1, min(PARTS, -(-rows * 16 // SMALL_BYTES))), "edges"), codec="zstd")


def _split(rows: DataFrame, spread: Column, parts: int, name: str) -> tuple:
    """Arguments of :func:`materialize`: the rows in so many parts, nulls in the first."""
    part = F.pmod(F.coalesce(spread, F.lit(0).cast("long")), F.lit(parts))
    split = [rows.where(part == F.lit(p)) for p in range(parts)] if parts > 1 else [rows]
    return split[0], name, *split[1:]


def batch_nodes(batches: DataFrame) -> DataFrame:
    """(batch_id, id, local): the distinct nodes of each batch and their places in id order."""
    ends = batches.select("batch_id", F.col("src").alias("id")).union(batches.select("batch_id", "dst")).distinct()
    return ends.withColumn("local", (F.row_number().over(Window.partitionBy("batch_id").orderBy("id")) - 1).cast("long"))


def with_chunks(batches: DataFrame, chunks: int) -> DataFrame:
    """Chunks of equal width over the positions of each batch; a chunk's positives share its negatives."""
    sizes = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    width = F.ceil(F.col("_n") / F.lit(chunks))
    return batches.join(sized_broadcast(sizes, 32), "batch_id").withColumn("chunk_id", F.floor(F.col("position") / width).cast("long")).drop("_n")


def uniform_negatives(chunks: DataFrame, nodes: int, count: int, salt: str = "negative") -> DataFrame:
    """(batch_id, chunk_id, neg_idx, node): ``count`` uniform draws for each (batch_id, chunk_id)."""
    drawn = chunks.select("batch_id", "chunk_id").distinct().withColumn("neg_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    return drawn.withColumn("node", h48(F.concat_ws("-", "batch_id", "chunk_id", "neg_idx"), salt) % F.lit(nodes))


def degree_negatives(chunked: DataFrame, count: int, corrupt: str = "dst", salt: str = "degree") -> DataFrame:
    """(batch_id, chunk_id, neg_idx, node, from_position): ends of edges drawn from the batch, so by degree."""
    sizes = chunked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n"))
    drawn = chunked.select("batch_id", "chunk_id").distinct().withColumn("neg_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(sizes, "batch_id")
    drawn = drawn.withColumn("position", h48(F.concat_ws("-", "batch_id", "chunk_id", "neg_idx"), salt) % F.col("_n")).drop("_n")
    ends = chunked.select("batch_id", "position", F.col(corrupt).alias("node"))
    return drawn.join(ends, ["batch_id", "position"]).select("batch_id", "chunk_id", "neg_idx", "node", F.col("position").alias("from_position"))


#: Node numbers that are made at a time.
RANGE = 1 << 16


def all_node_negatives(chunks: DataFrame, nodes: int) -> DataFrame:
    """Every node as a negative of each chunk (``negatives = -1``); ranges of nodes are made first, so no row holds all of them."""
    long = lambda x: F.lit(x).cast("long")
    ranges = chunks.select("batch_id", "chunk_id").distinct().withColumn("_from", F.explode(F.sequence(long(0), long(max(nodes - 1, 0)), long(RANGE))))
    drawn = ranges.withColumn("neg_idx", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + long(RANGE - 1), long(nodes - 1)))))
    return drawn.drop("_from").withColumn("node", F.col("neg_idx"))


def negatives(chunked: DataFrame, nodes: int, count: int, degree_fraction: float = 0.0, corrupt: str = "dst", filtered: bool = False, salt: str = "") -> DataFrame:
    """(batch_id, chunk_id, neg_idx, node, from_position): degree-biased draws first, then uniform ones."""
    if filtered or count < 0:
        return all_node_negatives(chunked, nodes).withColumn("from_position", F.lit(None).cast("long"))
    by_degree = math.floor(count * degree_fraction)
    rest = None
    if count > by_degree:
        rest = uniform_negatives(chunked, nodes, count - by_degree, salt or "negative").withColumn("neg_idx", F.col("neg_idx") + F.lit(by_degree)).withColumn("from_position", F.lit(None).cast("long"))
    if not by_degree:
        return rest
    first = degree_negatives(chunked, by_degree, corrupt, f"degree{salt}")
    return first if rest is None else first.unionByName(rest)


def degree_collisions(chunked: DataFrame, drawn: DataFrame) -> DataFrame:
    """(batch_id, position, neg_idx): degree negatives that meet the very edge they were drawn from, in its own chunk."""
    hit = drawn.where("from_position is not null").select("batch_id", "chunk_id", "neg_idx", F.col("from_position").alias("position"))
    return hit.join(chunked.select("batch_id", "chunk_id", "position"), ["batch_id", "chunk_id", "position"]).select("batch_id", "position", "neg_idx")


def local_collisions(chunked: DataFrame, drawn: DataFrame, corrupt: str = "dst") -> DataFrame:
    """(batch_id, position, neg_idx): negatives that make an edge of the same batch."""
    keep = "src" if corrupt == "dst" else "dst"
    known = chunked.select("batch_id", keep, "rel", F.col(corrupt).alias("node")).distinct()
    meets = chunked.select("batch_id", "chunk_id", "position", keep, "rel").join(known, ["batch_id", keep, "rel"])
    return meets.join(drawn.select("batch_id", "chunk_id", "neg_idx", "node"), ["batch_id", "chunk_id", "node"]).select("batch_id", "position", "neg_idx")


def global_collisions(edges: DataFrame, known: DataFrame, corrupt: str = "dst") -> DataFrame:
    """(edge, node): replacements of an edge's end that make any known edge, the true end included."""
    keep = "src" if corrupt == "dst" else "dst"
    return edges.select("edge", keep, "rel").join(known.select(keep, "rel", F.col(corrupt).alias("node")), [keep, "rel"]).select("edge", "node").distinct()


def apply_score_filter(scores: DataFrame, collisions: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of false negatives become -1e9."""
    marked = scores.join(collisions.select(*keys, F.lit(1).alias("_hit")).distinct(), keys, "left")
    return marked.withColumn("score", F.when(F.col("_hit").isNotNull(), F.lit(-1e9)).otherwise(F.col("score"))).drop("_hit")


def select_hard(scored: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best-scored negatives of each edge, ties by node: dynamic and adversarial sampling."""
    w = Window.partitionBy("edge").orderBy(F.desc("score"), "node")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def random_nodes(spark: SparkSession, nodes: int, count: int, salt: str = "nodes") -> DataFrame:
    return spark.range(count).select(F.col("id").alias("draw"), (h48(F.col("id"), salt) % F.lit(nodes)).alias("node"))
