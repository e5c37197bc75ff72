"""The grid against the chunk kernels, with blocks of a few nodes."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.functions import losses
from graphloom.operators import batches as B
from graphloom.operators import encoders, evaluate, grid, scoring
from graphloom.operators import kernels as K
from graphloom.runtime import materialize

NODES = 23


@pytest.fixture(scope="module")
def tables(spark):
    edges = spark.range(120).select(F.col("id").alias("edge"), (F.col("id") * 7 % 11).alias("src"), (F.col("id") % 3).alias("rel"), (F.col("id") * 5 % NODES).alias("dst"))
    edges = edges.unionByName(spark.createDataFrame([(500, 99, 0, 1), (501, 1, 0, 99), (502, 1, 9, 2)], edges.schema))  # unknown ends and an unknown relation
    cells = lambda c, n: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda d: F.sin(c * 1.7 + d * n))
    nodes = materialize(spark.range(NODES).select("id", cells(F.col("id"), 2.3).alias("emb")), "nodes")
    rels = spark.range(3).select(F.col("id").alias("rel"), cells(F.col("id"), 0.9).alias("emb"))
    batches = materialize(B.with_chunks(B.assign_batches(edges, F.col("edge"), 20), 2), "batches")
    return batches, materialize(B.uniform_negatives(batches, NODES + 2, 5), "drawn"), nodes, rels


@pytest.fixture(params=[64 << 20, 400])
def blocks(request, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK_BYTES", request.param)


@pytest.mark.parametrize("decoder", ["DISTMULT", "COMPLEX", "TRANSE"])
def test_scores(tables, blocks, decoder):
    packed = grid.packed_scores(*tables, decoder).cache()
    want = {(r["edge"], r["node"], r["label"]): r["score"] for r in K.chunk_scores(K.chunk_rows(*tables), decoder).collect()}
    got = {(r["edge"], r["dst"], 1): r["score"] for r in packed.collect()} | {(r["edge"], r["node"], 0): r["score"] for r in grid.negatives_of(packed).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_losses_ranks_and_choices(tables, blocks):
    packed = grid.packed_scores(*tables).cache()
    rows = K.chunk_scores(K.chunk_rows(*tables)).cache()
    for name in losses.LOSSES:
        for reduction in losses.REDUCTIONS:
            assert losses.packed_loss(name)(packed, reduction).first()["loss"] == pytest.approx(losses.get_loss(name)(rows, reduction).first()["loss"], abs=1e-9)
    assert {tuple(r) for r in evaluate.packed_ranks(packed).collect()} == {tuple(r) for r in evaluate.ranks(rows.withColumn("score", F.round("score", 9))).collect()}
    negatives = rows.where("label = 0").select("edge", "node", "score")
    assert {(r["edge"], r["node"], r["place"]) for r in grid.hardest_of(packed, 2).collect()} == {(r["edge"], r["node"], r["place"]) for r in B.select_hard(negatives, 2).collect()}
    rewarded = scoring.generator_loss(negatives.withColumn("reward", scoring.rewards(F.col("score")))).first()["loss"]
    assert scoring.packed_generator_loss(packed.select("scores", F.transform("scores", scoring.rewards).alias("rewards"))).first()["loss"] == pytest.approx(rewarded, abs=1e-9)


@pytest.mark.parametrize(("decoder", "loss", "method"), [("DISTMULT", "SOFTMAX_CE", "RNS"), ("COMPLEX", "RANKING", "DNS"), ("TRANSE", "SOFTPLUS", "GAN")])
def test_gradients(tables, blocks, decoder, loss, method):
    step = K.Step(decoder, loss, method=method, ratio=0.5)
    own = tables[2].select("id", F.reverse("emb").alias("emb")) if method == "GAN" else None
    got = materialize(grid.grid_gradients(*tables, step, generator=own), "got")
    want = materialize(K.chunk_gradients(K.chunk_rows(*tables, generator=own), step), "want")
    for kind in (K.NODE, K.RELATION, K.GENERATOR):
        a, b = ({r["id"]: r["g"] for r in K.sum_gradients(t, kind).collect()} for t in (got, want))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in b)
    totals = [t.where(F.col("kind") == K.TOTAL).agg(F.sum("loss"), F.sum("terms"), F.sum("pairs")).first() for t in (got, want)]
    assert tuple(totals[0]) == pytest.approx(tuple(totals[1]))


def test_vectors_travel_once_for_each_block(tables):
    """At most once for each shuffle partition here, not once for each chunk: what grew with the edges and filled the disks."""
    batches, drawn, nodes, rels = tables
    rows = grid._meeting(batches, drawn, grid.Nodes(nodes), rels.withColumnRenamed("emb", "vec"), "DISTMULT")
    lefts = rows.where(F.col("kind") == grid.LEFT).count()
    assert lefts <= 4 * NODES < K.chunk_rows(*tables).where(F.col("kind") == K.NODE).count()
    assert rows.where(F.size("vec") < 0).isEmpty()  # null lists slow Arrow's writers down
    assert K.chunk_rows(*tables).where("vec is null or own is null").isEmpty()


@pytest.mark.parametrize("to", ["node", "nbr"])
def test_products(spark, blocks, monkeypatch, to):
    rows = materialize(spark.range(200).select((F.col("id") * 3 % 17).alias("node"), (F.col("id") * 5 % NODES).alias("nbr"), (F.col("id") / 7).alias("w")), "rows")
    vectors = materialize(spark.range(NODES - 2).select("id", F.array(F.sin("id"), F.cos("id")).alias("g")), "vectors")
    source = "nbr" if to == "node" else "node"
    want = {r["id"]: r["g"] for r in encoders.product(rows, vectors, to, source).collect()}
    monkeypatch.setattr(grid, "MANY", 0)
    got = {r["id"]: r["g"] for r in encoders.product(rows, vectors, to, source).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    parts = grid.product(rows, vectors, to, source)
    assert parts.count() == parts.select("id", F.spark_partition_id()).distinct().count() or grid.BLOCK_BYTES == 400  # no row for each pair


def test_pairs_travel_packed(tables):
    """Rows of a stretch's pairs, not rows of pairs: what made two shuffles of all edges wide."""
    batches, drawn, nodes, rels = tables
    rows = grid._meeting(batches, drawn, grid.Nodes(nodes), rels.withColumnRenamed("emb", "vec"), "DISTMULT")
    packed = rows.where(F.col("kind") == grid.PAIR).select("pairs").collect()
    pairs = [len(grid._unpacked([bytes(r["pairs"])])) for r in packed]
    assert sum(pairs) == 120 and len(pairs) < 120  # three edges have an unknown end or relation


def test_written_tables_leave_no_shuffle_files(spark):
    count = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = count()
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "grouped")
    for _ in range(50):
        if count() <= before:
            return
        time.sleep(0.2)
    raise AssertionError("shuffle files stay")


def test_ends_meet_in_passes(tables, monkeypatch):
    """Streamed vectors are shuffled in passes, each once to a held block, and the tables of the batches go when they are read."""
    monkeypatch.setattr(grid, "BLOCK_BYTES", 400)
    batches, drawn, nodes, rels = tables
    edges = batches.select("edge", "src", "rel", "dst").dropna()
    steps = grid._at_ends(edges, grid.Nodes(nodes), rels.select("rel", F.col("emb").alias("vec")), "src", "dst")
    own = materialize(batches, "own")
    seen = [{(r["stretch"], r["id"]) for r in x.where("kind = 1 and stretch >= 0").collect()} | {(r["stretch"], -1) for r in x.where("kind = 3").collect()} for x in steps]
    assert len(steps) == 5 and all(not a & b for i, a in enumerate(seen) for b in seen[:i]) and len(set().union(*seen)) >= NODES
    rows = grid.grid_gradients(own, materialize(drawn, "drawn"), nodes, rels, K.Step(), spend=True)
    assert rows.where(F.col("kind") == K.NODE).groupBy("id").count().where(f"count > {len(steps)}").isEmpty()
    with pytest.raises(Exception, match="NOT_EXIST|does not exist|FILE_NOT_FOUND"):
        own.sparkSession.read.parquet(own._scratch).count()
    want = {r["id"]: r["g"] for r in K.sum_gradients(materialize(grid.grid_gradients(batches, drawn, nodes, rels, K.Step()), "again"), K.NODE).collect()}
    got = {r["id"]: r["g"] for r in grid.summed(rows, K.NODE).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_numbering_shuffles_the_edges_alone(tables):
    """Keys that order the rows are made on both sides of the shuffle: the numbers are those of rows that carry them."""
    edges = tables[0].select("edge", "src")
    key = F.col("edge") * 31 % 17
    carried = edges.withColumn("_a", key).orderBy("_a", "edge").collect()
    got = runtime.number_rows(edges, [], "n", keys={"_a": key, "_b": F.col("edge")})
    assert got.columns == ["edge", "src", "n"] and [r["edge"] for r in got.orderBy("n").collect()] == [r["edge"] for r in carried]


def test_batches_are_numbered_in_ranges(spark, monkeypatch):
    """No shuffle, and no table but the result, has all edges at once; the numbers are those of one range."""
    edges = spark.range(300).select((F.col("id") * 7 % 41).alias("src"), (F.col("id") % 3).alias("rel"), F.col("id").alias("dst"))
    edges = edges.unionByName(edges.where("dst = 0").withColumn("src", F.lit(None).cast("long")))
    key = F.col("src") * 1000 + F.col("dst")
    want = {tuple(r) for r in B.with_chunks(B.assign_batches(edges, key, 40), 3).select("src", "rel", "dst", "batch_id", "chunk_id").collect()}
    written = []
    monkeypatch.setattr(B, "materialize", lambda df, *a, **b: written.append(df.count()) or materialize(df, *a, **b))
    for rows, parts in ((301, 1), (1 << 40, B.PARTS)):
        written.clear()
        got = B.written_batches(edges, rows, F.xxhash64("dst"), key, 40, 3)
        assert {tuple(r) for r in got.select("src", "rel", "dst", "batch_id", "chunk_id").collect()} == want and got.count() == len(want)
        assert len(written) >= 1 + parts and (parts == 1 or max(written) < 200)


def test_losses_in_passes(tables, monkeypatch):
    """The pairs of one pass over the chunks are shuffled at a time."""
    monkeypatch.setattr(grid, "PAIR_BYTES", grid.BLOCK_BYTES // 40)
    whole, parts = grid.packed_scores(*tables).cache(), grid.packed_parts(*tables)
    counts = [p.count() for p in parts]
    assert sum(counts) == whole.count() and max(counts) < sum(counts)
    for name, reduction in (("MSE", "SUM"), ("RANKING", "MEAN")):
        assert losses.packed_loss(name)(parts, reduction).first()["loss"] == pytest.approx(losses.packed_loss(name)(whole, reduction).first()["loss"], abs=1e-9)


def test_training_losses_come_from_the_grid(spark, monkeypatch):
    """The losses before and after an epoch need no task that holds a chunk of one large batch."""
    from graphloom import catalog

    def refused(*args, **kwargs):
        raise AssertionError("a chunk in one task")

    monkeypatch.setattr(K, "chunk_scores", refused)
    assert [r["epoch"] for r in catalog.QUERIES["train_epochs"](spark, "/root/testdata/sf0.001").orderBy("epoch").collect()] == [0, 1]
