"""Hard-negative mining by one-dimensional distance keys.

Components become integers, so scores (inner products) are exact. One more component brings every stored vector to the
greatest norm; then the nearest vectors of an anchor are those with the highest scores. Stored vectors are sorted by
(pivot, distance to it), the pivot being their nearest, and packed into blocks of consecutive keys. By the triangle
inequality a block whose distances lie in [lo, hi] holds nothing nearer to an anchor at distance d of the pivot than
max(d - hi, lo - d), so a radius around the anchor is an interval of keys for each pivot.

Each search begins with the blocks whose intervals hold the anchor's own distances, and widens the radius until it is
certified: nothing outside it can have a score as high as the last of the best ones found (or as the lowest allowed
score). Blocks that an earlier radius covered are not scanned again, and blocks that lie wholly inside the nearest
distance that counts are skipped. Positives are searched first; their scores bound the negatives' scores from above and
below, which is an annulus around the anchor.

Anchors (a stated set of queries) travel in packed blocks to the shards that their intervals meet, by a join on pivots;
a task holds one shard (``SHARD`` blocks) and streams anchors by. Only pivots (of at most ``PIVOTS`` of a sample of at
most ``SAMPLE`` rows) and counts of pivots are on the driver. Every row is indexed, and results are exact.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter
vectors are filled up with zeros; repeated rows, and rows with equal ids, are rows of their own (an anchor is not its own
positive, its copy may be); equal scores are ordered by id, then by place in the index; no anchors, or none with a
positive, or an empty table, give an empty result; extra columns are ignored. Components and scores are 64-bit integers;
vectors whose scores do not fit are beyond the contract and wrap around.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import draw, map_arrow, materialize, shuffle_partitions
from graphloom.runtime import number_rows

#: Pivots, rows that they are fitted on at most, rounds of fitting.
PIVOTS, SAMPLE, FITTING = 32, 4096, 5
#: Rows of a block, blocks of a shard; places whose anchors travel together; anchors scored at a time.
BLOCK, SHARD, TOGETHER, STEP = 1024, 16, 32_768, 256
#: What a component is multiplied by before it is rounded down.
SCALE = 256


def quantise(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, anchor, v, norm2, top, size) of rows (id, label, vector, anchor) that take part; v: little-endian longs."""
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    own = own.where("id is not null and label is not null and vector is not null")
    names = ["id", "label", "anchor", "v", "norm2", "top", "size"]

    def run(batches):
        for b in batches:
            lists = b.column("vector")
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner[~np.isfinite(x)], minlength=len(sizes)) == 0
            q = np.floor(np.where(np.isfinite(x), x, 0) * scale).astype("<i8")
            kept = np.flatnonzero(good)
            parts = np.split(q, np.cumsum(sizes)[:-1]) if len(sizes) else []
            vs = [parts[i] for i in kept]
            yield pa.RecordBatch.from_arrays([
                *(b.column(c).take(pa.array(kept)) for c in ("id", "label", "anchor")), pa.array([v.tobytes() for v in vs], pa.binary()), pa.array([float((v.astype(float) ** 2).sum()) for v in vs], pa.float64()),
                pa.array([float(np.abs(v.astype(float)).max(initial=0)) for v in vs], pa.float64()), pa.array([len(v) for v in vs], pa.int32()),
            ], names=names)

    return map_arrow(own, run, "id long, label long, anchor boolean, v binary, norm2 double, top double, size int")


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of longs, filled up with zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), "<i8").reshape(-1, width)
    return np.frombuffer(b"".join(v.ljust(8 * width, b"\0") for v in vectors), "<i8").reshape(-1, width)


class Space:
    """Pivots of the stored vectors, with the component that brings those to one norm."""

    def __init__(self, width: int, norm2: float, top: float, sample: np.ndarray):
        self.width, self.norm2 = width, norm2
        self.exact = top * top * max(width, 1) < 2.0**52
        x = self.raised(sample)
        chosen = [0]
        near = ((x - x[0]) ** 2).sum(1)
        while len(chosen) < PIVOTS and near.max(initial=0) > 0:  # the farthest row next
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
        self.pivots = x[chosen]
        for _ in range(FITTING):
            own = self.to_pivots(x).argmin(1)
            self.pivots = np.stack([x[own == k].mean(0) if (own == k).any() else p for k, p in enumerate(self.pivots)])

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors with the further component."""
        y = x.astype(float)
        return np.c_[y, np.sqrt(np.maximum(self.norm2 - (y * y).sum(1), 0))]

    def to_pivots(self, y: np.ndarray) -> np.ndarray:
        """Distances of vectors with the further component to all pivots."""
        p = self.pivots
        return np.sqrt(np.maximum((y * y).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * y @ p.T, 0))

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact inner products; as doubles (matrix products) where those are exact."""
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if self.exact else a @ b.T

    @property
    def slack(self) -> float:
        """More than any rounding error of a distance."""
        return 1e-3 + 1e-6 * math.sqrt(self.norm2)


def build(rows: DataFrame) -> tuple[Space | None, DataFrame | None, DataFrame | None]:
    """(space, blocks, numbered rows) of quantised rows; None for an empty table.

    Blocks: (block, shard, pivot, lo, hi, data), data being the packed rows (number, id, label, v).
    """
    rows = materialize(rows, "vectors")
    stats = rows.agg(F.max("size").alias("width"), F.max("norm2").alias("norm2"), F.max("top").alias("top")).first()
    if stats["width"] is None:
        return None, None, None
    width = max(stats["width"], 1)
    sample = [r["v"] for r in draw(rows.select("id", "label", "v"), ["id", "label", "v"], SAMPLE).collect()]
    space = Space(width, stats["norm2"], stats["top"], matrix(sample, width))

    def keyed(batches):
        for b in batches:
            d = space.to_pivots(space.raised(matrix(b.column("v").to_pylist(), width))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "label", "anchor", "v")), pa.array(d.argmin(1), pa.int32()), pa.array(d.min(1), pa.float64())], names=["id", "label", "anchor", "v", "pivot", "dist"])

    keys = map_arrow(rows.select("id", "label", "anchor", "v"), keyed, "id long, label long, anchor boolean, v binary, pivot int, dist double")
    numbered = materialize(number_rows(keys, [F.col(c) for c in ("pivot", "dist", "id", "label", "v")], "number"), "keys")
    first = {r["pivot"]: (r["first"], r["n"]) for r in numbered.groupBy("pivot").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # at most PIVOTS rows
    start, base, blocks = np.zeros(PIVOTS, np.int64), np.zeros(PIVOTS, np.int64), 0
    for p in sorted(first):
        start[p], base[p] = first[p][0], blocks
        blocks += -(-first[p][1] // BLOCK)
    at = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("pivot") + 1)
    rows = numbered.withColumn("block", at(base) + F.floor((F.col("number") - at(start)) / F.lit(BLOCK)))
    packed = rows.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.collect_list(F.struct("id", "number", "label", "v")).alias("data"))
    packed = packed.select("block", F.floor(F.col("block") / F.lit(SHARD)).alias("shard"), "pivot", "lo", "hi", F.sort_array("data").alias("data"))
    return space, materialize(packed, "blocks"), numbered


def _scan(space: Space, same: bool, k: int):
    """Arrow function over rows sorted by shard, blocks before anchors: (anchor, slot, score, number, id) of the best ``k`` of every visited block's rows for each slot."""
    names = ["anchor", "slot", "score", "number", "id"]

    def fields(column) -> dict[str, object]:
        flat = column.values
        return {f.name: flat.field(i) for i, f in enumerate(flat.type)}

    def best(key: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the k greatest allowed entries of each row; of equal ones those further left."""
        wide = key.shape[1]
        low = np.iinfo(np.int64).min
        if np.abs(key).max(initial=0) < 2**51:
            unique = np.where(allowed, key * BLOCK + (BLOCK - 1 - np.arange(wide)), low)
            at = np.argpartition(unique, wide - k, 1)[:, wide - k :] if wide > k else np.tile(np.arange(wide), (len(key), 1))
        else:
            at = np.argsort(~np.where(allowed, key, low), 1, kind="stable")[:, :k]  # the complement reverses the order without overflow
        row, col = np.repeat(np.arange(len(key)), at.shape[1]), at.ravel()
        good = allowed[row, col]
        return row[good], col[good]

    def visit(shard, anchors):
        """Rows found for one packed row of anchors."""
        total = len(anchors["anchor"])
        tops, lows = (anchors[c] for c in ("tops", "lows"))
        slots = max(map(len, tops), default=0)
        for s in range(0, total, STEP):
            part = slice(s, s + STEP)
            q = matrix(anchors["v"][part], space.width)
            number, label, done, radius = (anchors[c][part] for c in ("anchor", "label", "done", "radius"))
            y = q.astype(float)
            q2 = (y * y).sum(1)
            d = space.to_pivots(np.c_[y, np.zeros(len(y))])
            top = np.full((len(q), slots), np.iinfo(np.int64).min)
            low = np.full((len(q), slots), np.iinfo(np.int64).max)
            for i, (t, l) in enumerate(zip(tops[part], lows[part], strict=True)):
                top[i, : len(t)], low[i, : len(l)] = t, l
            nearest = np.sqrt(np.maximum(q2 + space.norm2 - 2 * np.minimum(top.max(1).astype(float), space.norm2 + q2), 0)) - space.slack
            for pivot, lo, hi, ids, numbers, labels, x in shard:
                own = d[:, pivot]
                bound = np.maximum(np.maximum(own - hi, lo - own), 0)
                rows = np.flatnonzero((bound <= radius) & (bound > done) & (own + hi >= nearest))
                if not len(rows):
                    continue
                found = space.scores(q[rows], x)
                fits = (labels[None] == label[rows, None]) if same else (labels[None] != label[rows, None])
                fits &= numbers[None] != number[rows, None]
                for slot in range(slots):
                    r, c = best(found, fits & (found <= top[rows, slot, None]) & (found >= low[rows, slot, None]))
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(number[rows[r]]), pa.array(np.full(len(r), slot, np.int32)), pa.array(found[r, c]), pa.array(numbers[c]), pa.array(ids[c])], names=names)

    def run(batches):
        shard, current = [], None
        for b in batches:
            for i in range(b.num_rows):
                at, pivot = b.column("shard")[i].as_py(), b.column("pivot")[i].as_py()
                if at != current:
                    shard, current = [], at
                if pivot is not None:
                    f = fields(_alone(b.column("data"), i))
                    shard.append((pivot, b.column("lo")[i].as_py(), b.column("hi")[i].as_py(), f["id"].to_numpy(), f["number"].to_numpy(), f["label"].to_numpy(), matrix(f["v"].to_pylist(), space.width)))
                else:
                    f = fields(_alone(b.column("queries"), i))
                    anchors = {c: f[c].to_numpy() for c in ("anchor", "label", "done", "radius")} | {c: f[c].to_pylist() for c in ("v", "tops", "lows")}
                    yield from visit(shard, anchors)

    return run


def _alone(lists: pa.ListArray, i: int) -> pa.ListArray:
    """One row of a list column, its values without the others'."""
    return pa.ListArray.from_arrays(pa.array([0, len(lists[i])], pa.int32()), lists[i].values)


ANCHORS = "array<struct<anchor:long,label:long,done:double,radius:double,v:binary,tops:array<long>,lows:array<long>>>"
FOUND = "anchor long, slot int, score long, number long, id long"


def search(space: Space, blocks: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, place, score, number, id): for each slot of each query the ``k`` best rows of the same label (or of
    other labels) with lows[slot] <= score <= tops[slot]. Queries: (anchor, label, v, tops, lows); anchor: a row's number.
    """
    spark = blocks.sparkSession
    queries = materialize(queries.select("anchor", "label", "v", "tops", "lows"), "queries")
    catalogue = blocks.groupBy("pivot", "shard").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = 2 * math.sqrt(space.norm2) + 1 + 2 * space.slack  # no two vectors are farther apart
    widths = queries.select("anchor", F.lit(-1.0).alias("done"), F.lit(0.0).alias("radius"))
    kept = spark.createDataFrame([], FOUND + ", place int")

    def intervals(batches):
        for b in batches:
            for i in range(b.num_rows):
                f = _alone(b.column("queries"), i).values
                y = matrix(f.field("v").to_pylist(), space.width).astype(float)
                d = space.to_pivots(np.c_[y, np.zeros(len(y))])
                r = f.field("radius").to_numpy()[:, None]
                n = d.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("group")[i].as_py()] * n, pa.int64()), pa.array(np.arange(n), pa.int32()), pa.array((d - r).min(0)), pa.array((d + r).max(0))], names=["group", "pivot", "least", "most"])

    while True:
        widths = materialize(widths, "widths")
        active = widths.where("radius > done")
        if active.isEmpty():
            return kept
        # Scores below the last of the best found so far are of no use any more.
        last = kept.where(F.col("place") == k).select("anchor", "slot", F.col("score").alias("last"))
        last = last.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("last"))
        rows = queries.join(active, "anchor").join(last, "anchor", "left")
        raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("last", i), x)))
        entry = F.struct("anchor", "label", "done", "radius", "v", "tops", F.when(F.col("last").isNull(), F.col("lows")).otherwise(raised).alias("lows"))
        packed = materialize(rows.groupBy(F.floor(F.col("anchor") / F.lit(TOGETHER)).alias("group")).agg(F.collect_list(entry).cast(ANCHORS).alias("queries")), "packed")
        met = map_arrow(packed, intervals, "group long, pivot int, least double, most double").join(catalogue, "pivot").where("hi >= least and lo <= most")
        visits = met.select("group", "shard").distinct()
        shards = blocks.select("shard", "block", "pivot", "lo", "hi", "data", F.lit(None).cast(ANCHORS).alias("queries"))
        empty = [F.lit(None).cast(t).alias(c) for c, t in blocks.select("block", "pivot", "lo", "hi", "data").dtypes]
        both = shards.unionByName(visits.join(packed, "group").select("shard", *empty, "queries"))
        both = both.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_last())
        found = map_arrow(both, _scan(space, same, k), FOUND)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "number")
        ranked = kept.drop("place").unionByName(found).withColumn("place", F.row_number().over(order))
        kept = materialize(ranked.where(F.col("place") <= k), "found")
        full = kept.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        ends = queries.select("anchor", F.posexplode("lows").alias("slot", "low")).join(full, ["anchor", "slot"], "left").groupBy("anchor").agg(F.min(F.coalesce("score", "low")).alias("needed"))
        norms = queries.select("anchor", "v")
        widths = _widen(widths.join(ends, "anchor").join(norms, "anchor"), space, whole)


def _widen(rows: DataFrame, space: Space, whole: float) -> DataFrame:
    """(anchor, done, radius) of the next round: the radius that certifies the scores needed, or twice the last where any score is."""

    def run(batches):
        for b in batches:
            done, radius = (np.asarray(b.column(c), float) for c in ("done", "radius"))
            needed = b.column("needed").to_numpy()
            y = matrix(b.column("v").to_pylist(), space.width).astype(float)
            certain = np.sqrt(np.maximum((y * y).sum(1) + space.norm2 - 2 * needed.astype(float), 0)) + space.slack
            open_ = needed == np.iinfo(np.int64).min
            reached = np.maximum(done, radius)
            new = np.where(open_, np.where(reached >= whole, reached, np.minimum(np.maximum(2 * reached, whole / 4), whole)), np.minimum(certain, whole))
            yield pa.RecordBatch.from_arrays([b.column("anchor"), pa.array(reached), pa.array(np.maximum(new, reached))], names=["anchor", "done", "radius"])

    return map_arrow(rows.select("anchor", "done", "radius", "needed", "v"), run, "anchor long, done double, radius double")


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = SCALE) -> DataFrame:
    """Hard negatives of rows (id, label, vector, anchor): for each anchor and each of its best ``positives`` of the same
    label, the best ``negatives`` of other labels that score at most as high and at least ``share`` per cent of it."""
    space, blocks, numbered = build(quantise(rows, scale))
    if space is None:
        return rows.sparkSession.createDataFrame([], MINED)
    anchors = materialize(numbered.where("anchor").select(F.col("number").alias("anchor"), F.col("id").alias("anchor_id"), "label", "v"), "anchors")
    long = lambda x: F.array(F.lit(x).cast("long"))
    best = search(space, blocks, anchors.withColumn("tops", long(2**63 - 1)).withColumn("lows", long(-(2**63))), positives, True)
    best = best.where("score >= 0").select("anchor", (F.col("place") - 1).alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    bounds = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda p: p["positive_score"]).alias("tops"))
    bounds = bounds.withColumn("lows", F.expr(f"transform(tops, p -> ({int(share)} * p + 99) div 100)"))
    found = search(space, blocks, anchors.join(bounds, "anchor"), negatives, False)
    out = found.join(best, ["anchor", "slot"]).join(anchors.select("anchor", "anchor_id"), "anchor")
    return out.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
