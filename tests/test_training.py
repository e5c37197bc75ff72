"""Training by chunk kernels: finite differences, plain loops, resumed runs, rounds over partitions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import DecoderType, GraphConfig, LossFunction, NegativeMethod, Optimizer
from graphloom.engine import GraphModel
from graphloom.operators import batches as B
from graphloom.operators import kernels as K
from graphloom.operators import scoring as D
from graphloom.operators import train as T
from graphloom.plans.rounds import pair_rounds

RNG = np.random.default_rng(3)
X, R, OWN = RNG.normal(size=(9, 4)), RNG.normal(size=(2, 4)), RNG.normal(size=(9, 4))
KEPT, REL, OTHER, NEG = np.array([0, 1, 0, 2]), np.array([0, 1, 1, 0]), np.array([3, 4, 5, 3]), np.array([3, 5, 6, 7, 8])
LEFT = np.array([1, 2]), np.array([2, 0])


def pair_loss(step, x, r, chosen):
    """The loss of a chunk by plain loops over its pairs."""
    total = 0.0
    for i, (a, q, b) in enumerate(zip(KEPT, REL, OTHER, strict=True)):
        m = K.moved(step.decoder, x[a][None], r[q][None])[0]
        score = lambda t: math.sqrt(max(((m - t) ** 2).sum(), 1e-8)) if step.decoder == "TRANSE" else float(m @ t)  # noqa: E731, B023
        pos, neg = score(x[b]), [score(x[n]) for j, n in enumerate(NEG) if chosen[i, j]]
        sp = lambda s: math.log(1 + math.exp(s))
        if step.loss in ("SOFTMAX_CE", "CROSS_ENTROPY"):
            total += math.log(math.exp(pos) + sum(map(math.exp, neg))) - pos
        elif step.loss == "RANKING":
            total += sum(max(0.0, n - pos + step.margin) for n in neg)
        elif step.loss == "MSE":
            total += (pos - 1) ** 2 + sum(n * n for n in neg)
        else:
            total += sp(-pos) + sum(map(sp, neg))
    return total


def difference(f, m):
    out = np.zeros_like(m)
    for i in np.ndindex(m.shape):
        up, down = m.copy(), m.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        out[i] = (f(up) - f(down)) / 2e-6
    return out


@pytest.mark.parametrize(("decoder", "loss", "method"), [*itertools.product(["DISTMULT", "COMPLEX", "TRANSE"], K.LOSSES, ["RNS"]), ("DISTMULT", "SOFTMAX_CE", "DNS"), ("COMPLEX", "RANKING", "DNS"), ("TRANSE", "SOFTMAX_CE", "GAN"), ("DISTMULT", "SOFTPLUS", "KBGAN")])
def test_kernel_gradients_match_finite_differences(decoder, loss, method):
    step = K.Step(decoder, loss, 0.3, method, 0.5 if method != "RNS" else 1.0)
    valid = K.valid_pairs(KEPT, OTHER, NEG, LEFT)
    assert not valid[1, 2] and not valid[2, 0] and not valid[0, 0] and valid.sum() == 20 - 2 - 3
    got = K.run_step(step, X, R, KEPT, REL, OTHER, NEG, valid.copy(), OWN)
    chosen = valid
    if method != "RNS":
        kept = 2
        m = K.moved(decoder, X[KEPT], R[REL])
        rank = K.all_scores(decoder, m, X[NEG]) if method == "DNS" else OWN[KEPT] @ OWN[NEG].T
        chosen = np.zeros_like(valid)
        for i in range(len(KEPT)):
            for j in sorted(np.flatnonzero(valid[i]), key=lambda j: (-rank[i, j], j))[:kept]:
                chosen[i, j] = True
    assert got.loss == pytest.approx(pair_loss(step, X, R, chosen)) and got.pairs == 4 + chosen.sum()
    assert np.allclose(got.nodes, difference(lambda x: pair_loss(step, x, R, chosen), X), atol=1e-5)
    assert np.allclose(got.relations, difference(lambda r: pair_loss(step, X, r, chosen), R), atol=1e-5)


def test_generator_gradient_matches_finite_differences():
    valid = K.valid_pairs(KEPT, OTHER, NEG, LEFT)
    m = K.moved("DISTMULT", X[KEPT], R[REL])
    reward = 2 * (1 / (1 + np.exp(-(m @ X[NEG].T))) - 0.5)

    def loss(own):
        total = 0.0
        for i in range(len(KEPT)):
            logits = {j: own[KEPT[i]] @ own[NEG[j]] for j in np.flatnonzero(valid[i])}
            z = sum(map(math.exp, logits.values()))
            total -= sum(math.log(math.exp(s) / z) * reward[i, j] * math.exp(s) / z for j, s in logits.items())
        return total

    got = K.run_step(K.Step("DISTMULT", method="GAN", ratio=0.5), X, R, KEPT, REL, OTHER, NEG, valid, OWN)
    assert got.generator_loss == pytest.approx(loss(OWN)) and got.generator_terms == valid.sum()
    assert np.allclose(got.generator, difference(loss, OWN), atol=1e-6)


def tables(spark, edges=40, nodes=12, relations=2, width=4):
    r = np.random.default_rng(1)
    rows = sorted({(int(a), int(q), int(b)) for a, q, b in zip(r.integers(0, nodes, edges), r.integers(0, relations, edges), r.integers(0, nodes, edges), strict=True)})
    vec = lambda n: [list(map(float, v)) for v in r.normal(size=(n, width))]
    e = spark.createDataFrame([(i, *x, "train") for i, x in enumerate(rows)], "edge long, src long, rel long, dst long, split string").repartition(3)
    n = spark.createDataFrame(list(enumerate(vec(nodes))), "id long, emb array<double>")
    q = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(vec(relations), vec(relations), strict=True))], "rel long, emb array<double>, inv_emb array<double>")
    return e, n, q


def test_chunk_gradients_match_pair_gradients(spark):
    """Kernels over several batches and chunks against the pair form, with a known edge left out."""
    e, n, q = tables(spark)
    batches = B.with_chunks(B.assign_batches(e, F.col("edge"), 15), 2).cache()
    drawn = B.uniform_negatives(batches, 12, 5).cache()
    known = B.global_collisions(batches, e)
    pairs = T.train_pairs(batches, drawn).join(known.withColumn("label", F.lit(0)), ["edge", "node", "label"], "left_anti").cache()
    scored = T.distmult_scores(pairs, n, q)
    got = K.chunk_rows(batches, drawn, n, q, left_out=known)
    assert {(r["edge"], r["node"], r["label"]): round(r["score"], 9) for r in K.chunk_scores(got).collect()} == {(r["edge"], r["node"], r["label"]): round(r["score"], 9) for r in scored.collect()}
    rows = K.chunk_gradients(got, K.Step()).cache()
    for kind, want in ((K.NODE, T.gradients(scored, n, q)[0]), (K.RELATION, T.gradients(scored, n, q)[1])):
        a, b = ({r[0]: r["g"] for r in x.collect()} for x in (K.sum_gradients(rows, kind), want))
        a = {k: v for k, v in a.items() if any(v)}
        assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert rows.where(F.col("kind") == K.TOTAL).agg(F.sum("pairs")).first()[0] == pairs.count()


def settings(epochs, optimizer=Optimizer.ADAGRAD, method=NegativeMethod.RNS):
    c = GraphConfig()
    c.model.embedding_dim, c.training.num_epochs, c.training.batch_size = 4, epochs, 100
    c.training.negatives.negatives_per_positive, c.training.negatives.num_chunks, c.training.negatives.method, c.training.negatives.ratio = 5, 2, method, 0.5
    for o in (c.model.sparse_optimizer, c.model.dense_optimizer):
        o.type, o.learning_rate = optimizer, 0.05
    return c


def snapshot(model):
    t = model.tables
    return [sorted(map(str, x.collect())) for x in (t.node_embeddings.select(sorted(t.node_embeddings.columns)), t.relation_embeddings.select(sorted(t.relation_embeddings.columns)))]


@pytest.mark.parametrize(("optimizer", "method"), [(Optimizer.SGD, NegativeMethod.RNS), (Optimizer.ADAGRAD, NegativeMethod.DNS), (Optimizer.ADAM, NegativeMethod.GAN)])
def test_resumed_training_is_the_same(spark, tmp_path, optimizer, method):
    e, _, _ = tables(spark)
    two = GraphModel.create(spark, settings(2, optimizer, method), e)
    two.train()
    one = GraphModel.create(spark, settings(1, optimizer, method), e)
    one.train()
    one.save(str(tmp_path))
    again = GraphModel.create(spark, settings(1, optimizer, method), e)
    again.load(str(tmp_path), 1)
    again.train()
    assert again.epoch == 2 and again.steps == two.steps and snapshot(again) == snapshot(two) and snapshot(one) != snapshot(two)
    report = two.report()
    assert report.count() == two.steps and report.agg(F.min("pairs")).first()[0] > 0
    if method is NegativeMethod.GAN:
        assert two.tables.generator_embeddings.columns[:2] == ["id", "emb"] and report.where("generator_loss is null").isEmpty()


def test_batches_of_a_step_add_up(spark):
    """Batches side by side make one step from the same parameters, so their order does not matter."""
    e, n, q = tables(spark)
    config = T.TrainConfig(1, 10, 2, 5, 0.05, 0.05, batches_per_step=100)
    nodes, _ = T.train(e, n, q, config)
    batches = B.with_chunks(B.assign_batches(e, F.col("edge"), 10, "epoch0"), 2).cache()
    rows = T.step_gradients(batches, e, T.Parameters(n, q), config, 12, "epoch0").cache()
    want = T.apply_adagrad(n, K.sum_gradients(rows, K.NODE), "id", 0.05)
    a, b = ({r["id"]: r["emb"] for r in x.collect()} for x in (nodes, want))
    assert len(config.progress) == 1 and all(np.allclose(a[k], b[k]) for k in a)


def test_rounds_cover_all_pairs_once():
    for n in (2, 4, 5, 16):
        rounds = pair_rounds(n)
        assert sorted(p for r in rounds for p in map(tuple, r)) == list(itertools.combinations(range(n), 2))
        assert all(len({q for p in r for q in p}) == 2 * len(r) for r in rounds)


def test_a_round_follows_its_batches_in_order(spark):
    """One state that holds everything, against a plain loop over its batches."""
    e, n, q = tables(spark)
    config = T.TrainConfig(1, 13, 2, 5, 0.1, 0.1, method="DNS", ratio=0.5)
    nodes, rels = T.train_rounds(e, n, q, [[[0, 1]]], 6, config)
    x, r = np.array([v["emb"] for v in n.orderBy("id").collect()]), [np.array([v[c] for v in q.orderBy("rel").collect()]) for c in ("emb", "inv_emb")]
    sx, sr = np.zeros_like(x), [np.zeros_like(v) for v in r]
    rows = [tuple(v) for v in e.select("src", "rel", "dst", T.h48(F.col("edge"), "epoch0-0").alias("h")).orderBy("h").drop("h").collect()]
    for b, i in enumerate(range(0, len(rows), 13)):
        block = np.array(rows[i : i + 13])
        gx, gr, width = np.zeros_like(x), [np.zeros_like(v) for v in r], -(-len(block) // 2)
        for c in range(0, len(block), width):
            s, q_, d = block[c : c + width].T
            for side, (a, o) in enumerate(((s, d), (d, s))):
                neg = np.unique(T.draws(0, b, c // width, 5, 12, "epoch0-0" if side == 0 else "epoch0-0-src"))
                f = K.run_step(config.step(), x, r[side], a, q_, o, neg, K.valid_pairs(a, o, neg))
                gx, gr[side] = gx + f.nodes, gr[side] + f.relations
        for m, state, g in ((x, sx, gx), (r[0], sr[0], gr[0]), (r[1], sr[1], gr[1])):
            state += g * g
            m -= 0.1 * g / (np.sqrt(state) + 1e-10)
    assert np.allclose(x, [v["emb"] for v in nodes.orderBy("id").collect()]) and np.allclose(sx, [v["state"] for v in nodes.orderBy("id").collect()])
    got = rels.orderBy("rel").collect()
    assert np.allclose(r[0], [v["emb"] for v in got]) and np.allclose(r[1], [v["inv_emb"] for v in got])


def test_a_round_takes_a_batch_in_tiles(spark, monkeypatch):
    """A batch of which a task holds the vectors of a few edges at a time makes the same step."""
    e, n, q = tables(spark)
    found = []
    for tile in (1 << 13, 5):
        monkeypatch.setattr(T, "TILE", tile)
        config = T.TrainConfig(1, 1 << 40, 2, 5, 0.1, 0.1, method="DNS", ratio=0.5)
        nodes, rels = T.train_rounds(e, n, q, [[[0, 1]]], 6, config)
        found.append([np.array([v[c] for v in t.orderBy(k).collect()]) for t, k, c in ((nodes, "id", "emb"), (nodes, "id", "state"), (rels, "rel", "emb"), (rels, "rel", "inv_emb"))] + [[r["loss"] for r in config.progress], [r["pairs"] for r in config.progress]])
    assert all(np.allclose(a, b) for a, b in zip(*found, strict=True))


def test_model_trains_several_partitions(spark):
    e, _, _ = tables(spark, 60)
    c = settings(1)
    c.storage.partitions.num_partitions = 4
    model = GraphModel.create(spark, c, e)
    model.train()
    t = model.tables
    assert t.node_embeddings.count() == 12 and t.node_embeddings.where("exists(state, x -> x > 0)").count() == 12
    assert len(model.progress) == 3 and sum(r["pairs"] for r in model.progress) > 2 * e.count()
    c.training.negatives.method = NegativeMethod.GAN
    with pytest.raises(ValueError):
        model.train()


def test_odd_tables(spark):
    """Edges of unknown nodes take no part; no edges at all leave everything as it is; a loss that overflows is an error."""
    e, n, q = tables(spark)
    lost = spark.createDataFrame([(999, 0, 0, 500, "train")], e.schema)
    a = T.train(e.unionByName(lost).where("edge = 999 or edge < 5"), n, q, T.TrainConfig(1, 100, 1, 4))[0]
    assert a.count() == 12 and a.where("id = 500").isEmpty()
    nodes, rels = T.train(e.limit(0), n, q, T.TrainConfig(1, 10, 2, 5))
    assert sorted(map(str, nodes.select("id", "emb").collect())) == sorted(map(str, n.collect())) and rels.count() == 2
    huge = n.withColumn("emb", F.transform("emb", lambda x: x * 1e200))
    with pytest.raises(ValueError, match="loss"):
        T.train(e, huge, q, T.TrainConfig(1, 100, 1, 5))
    with pytest.raises(ValueError):
        K.Step("NODE")
    assert LossFunction.RANKING.name in K.LOSSES and DecoderType.TRANSE.name == "TRANSE"


def test_fit_evaluates_and_saves(spark, tmp_path):
    e, _, _ = tables(spark)
    c = settings(2)
    c.model.random_seed, c.training.epochs_per_checkpoint, c.evaluation.epochs_per_eval, c.training.batch_size = 5, 2, 2, 100
    c.evaluation.negatives.filtered, c.evaluation.negatives.negatives_per_positive = False, 6
    model = GraphModel.create(spark, c, e)
    assert model.tables.node_embeddings.first()["emb"] != GraphModel.create(spark, settings(1), e).tables.node_embeddings.first()["emb"]
    found = model.fit(str(tmp_path), "train")
    assert [r["epoch"] for r in found] == [2] and 1 <= found[0]["MR"] <= 7 and c.training.num_epochs == 2
    again = GraphModel.create(spark, c, e)
    again.load(str(tmp_path), 2)
    assert again.epoch == 2 and snapshot(again) == snapshot(model)


@pytest.mark.parametrize("decoder", ["DISTMULT", "COMPLEX", "TRANSE", "COSINE"])
def test_every_relation_is_tried(spark, monkeypatch, decoder):
    e, n, _ = tables(spark)
    q = spark.createDataFrame([(i, [float(v) for v in RNG.normal(size=4)]) for i in range(7)], "rel long, emb array<double>")
    d = D.get_decoder(decoder, decoder == "TRANSE")
    pairs = e.drop("rel", "split").join(n.select(F.col("id").alias("src"), F.col("emb").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("emb").alias("b")), "dst").join(q)
    want = {(r["edge"], r["rel"]): r["s"] for r in pairs.select("edge", "rel", d.score(F.col("a"), F.col("emb"), F.col("b")).alias("s")).collect()}
    for block in (1024, 2):
        monkeypatch.setattr(D, "RELATION_BLOCK", block)
        got = {(r["edge"], r["other_rel"]): r["score"] for r in D.score_relations(e, n, q, d).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
