"""Mixing sources to target weights along a curriculum.

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. They share ``BUDGET`` times all words; a
source's target stops at ``EPOCHS`` times its size and the excess is shared anew by weight until no target is above.
Each source spends its target along a weight schedule over training time: the schedule is integrated, and a draw that
covers words c to c + n of the source's demand gets the time at which the integral reaches the draw's middle. Draws go
through a source in hash order, pass after pass; the last draw of a source takes only the words still missing, so a
source's words equal its target to within one word. Documents are then range-sorted by time.

Running totals inside a source are taken per (source, hash bucket) and shifted by the totals of the buckets before, so
no task holds a source. All steps are DataFrame functions.

Defined cases: a null or blank text has size 0 and takes no words (no draw); a null source is a source of its own, the
last; repeated rows are separate rows; with no words at all every target is 0; an empty table gives an empty result;
extra columns, whatever their names, pass through :func:`mix_documents`, where rows equal in id and text carry the
columns of the one with the lowest hash; a null doc_id has a place in the order like any other; texts of any length
count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, shuffle_partitions
from graphloom.runtime import number_rows

#: Weights by rank, repeating; words to share and a source's limit, as multiples of sizes.
WEIGHTS, BUDGET, EPOCHS = (5, 2, 1), 1.5, 2
#: Weight schedules by rank, repeating: (time, weight) knots over [0, 1], linear between them.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Fixed value: what words are made of.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash buckets of a source for each shuffle partition.
SPREAD = 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    """48 bits of md5 of the id: the order in which a source's documents are drawn."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":mix")).cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(key, source, source_size, weight, kind, target) from rows of (key, source, size)."""
    totals = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = number_rows(totals, [F.col("source").asc_nulls_last(), F.col("key").asc()], "rank")
    kind = F.pmod(F.col("rank"), F.lit(len(WEIGHTS))).cast("int")
    ranked = materialize(ranked.select("key", "source", "source_size", kind.alias("kind"), F.element_at(F.array(*map(F.lit, WEIGHTS)), kind + 1).cast("double").alias("weight")), "sources")
    limit = F.col("source_size") * F.lit(float(EPOCHS))
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else limit <= F.lit(level) * F.col("weight")
        r = ranked.agg(
            F.sum("source_size").alias("all"), F.count_if(over).alias("n"), F.sum(F.when(over, limit).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if r["n"] == stopped or not r["open"]:
            break
        stopped, level = r["n"], (BUDGET * r["all"] - r["capped"]) / r["open"]
    return ranked.withColumn("target", F.least(limit, F.lit(level or 0.0) * F.col("weight")))


def _time(share: Column, kind: Column) -> Column:
    """Time at which a schedule's integral reaches a share of its whole: the inverse of a piecewise quadratic."""
    out = F.lit(0.0)
    for k, knots in enumerate(SCHEDULES):
        areas = [0.0]
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
        y, inverse = share * F.lit(areas[-1]), F.lit(knots[-1][0])
        for i in reversed(range(len(knots) - 1)):
            (t0, w0), (t1, w1) = knots[i], knots[i + 1]
            part, slope = y - F.lit(areas[i]), (w1 - w0) / (t1 - t0)
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * part, F.lit(0.0)))
            inverse = F.when(y <= F.lit(areas[i + 1]), F.lit(t0) + F.lit(2.0) * part / (F.lit(w0) + root)).otherwise(inverse)
        out = F.when(kind == k, inverse).otherwise(out)
    return out


def plan_mix(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, size, source, source_size, target, copy, draws) of every row; copy: its number among rows equal in id and text; draws: array of (pass, words, position)."""
    spark = docs.sparkSession
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("text_key")
    )
    own = own.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).withColumn("at", order_key(F.col("doc_id")))
    buckets = shuffle_partitions(spark) * SPREAD
    rows = materialize(own.withColumn("bucket", F.floor(F.col("at") / F.lit((1 << 48) / buckets)).cast("int")), "sizes")

    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    targets = source_targets(rows.select("key", "source", "size"))
    sums = sums.join(targets.drop("source", "weight"), "key")

    inside = Window.partitionBy("key", "bucket").orderBy("at", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["key", "bucket"])
    before = F.col("base") + F.col("ahead")
    goal = F.floor(F.col("target") + 0.5).cast("long")

    def draw(n: Column) -> Column:
        start = n * F.col("source_size") + before
        words = F.greatest(F.least(F.col("size"), goal - start), F.lit(0))
        middle = (start + words / F.lit(2.0)) / F.greatest(goal, F.lit(1))
        return F.struct(n.alias("pass"), words.alias("words"), _time(middle, F.col("kind")).alias("position"))

    draws = F.filter(F.array(*[draw(F.lit(n).cast("long")) for n in range(EPOCHS)]), lambda d: d["words"] > 0)
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy(before))
    return rows.select("doc_id", "text_key", "size", "source", "source_size", "target", copy.alias("copy"), draws.alias("draws"))


def place(doc_id: Column, text_key: Column) -> Column:
    """One key for a row's id, null or not, and its text, so that a join and a window share one shuffle of the texts."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("n")), text_key.cast("string"))


def mix_documents(docs: DataFrame, plan: DataFrame | None = None, draw: str | None = None) -> DataFrame:
    """The mix itself: a row, with all columns of ``docs``, for each draw, range-sorted by training time.

    A draw that takes only part of a document carries that many of its words, from the front and as they stand. ``plan``:
    that of :func:`plan_mix`, if it is written already; ``draw``: the name of one more column, (place, copy, position), which
    says whose draw a row is and its time.
    """
    plan = (plan_mix(docs) if plan is None else plan).where(F.size("draws") > 0)
    draws = F.transform("draws", lambda d: F.struct(F.col("copy"), d["words"].alias("words"), d["position"].alias("position")))
    plan = plan.groupBy(place(F.col("doc_id"), F.col("text_key")).alias("place")).agg(F.max("size").alias("size"), F.flatten(F.collect_list(draws)).alias("draws"))
    own_id = F.col("doc_id").cast("long")
    own = docs.select(F.struct("*").alias("row"), own_id.alias("own_id"), place(own_id, F.xxhash64(F.col("text").cast("string"))).alias("place"))
    # Rows of one place are equal in text, which so need not be hashed.
    once = Window.partitionBy("place").orderBy(F.xxhash64(F.to_json(F.col("row").dropFields("text"))))
    rows = own.join(plan, "place")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1").select("row", "own_id", "place", "size", F.explode("draws").alias("draw"))
    text = F.col("row.text").cast("string")
    words = F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("draw.words").cast("int")), "")
    rows = rows.select(F.col("row").withField("text", F.when(F.col("draw.words") < F.col("size"), cut).otherwise(text)).alias("row"), F.struct("place", "draw.copy", "draw.position").alias("draw"), F.col("draw.position").alias("position"), "own_id")
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "position").sortWithinPartitions("position", "own_id")
    return rows.select("row.*", *([F.col("draw").alias(draw)] if draw else []))
