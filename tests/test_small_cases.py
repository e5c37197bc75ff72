"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import losses
from graphloom.functions import vectors as V
from graphloom.config import DecoderType, GraphConfig, NegativeMethod
from graphloom.engine import GraphModel
from graphloom.operators import evaluate, preprocess, train
from graphloom.operators.scoring import get_decoder
from graphloom.operators.sums import reduce_vectors

PAIR = [(1, 1.0, 1), (1, 0.0, 0), (1, 2.0, 0)]


def scores(spark):
    return spark.createDataFrame(PAIR, "edge long, score double, label int")


@pytest.mark.parametrize(
    ("name", "reduction", "want"),
    [("SOFTMAX_CE", "SUM", 1.407606), ("RANKING", "SUM", 1.1), ("RANKING", "MEAN", 0.55), ("BCE_WITH_LOGITS", "SUM", 3.133337), ("SOFTPLUS", "SUM", 3.133337), ("MSE", "SUM", 4.0), ("BCE_AFTER_SIGMOID", "SUM", 3.133337)],
)
def test_losses(spark, name, reduction, want):
    assert losses.get_loss(name.lower())(scores(spark), reduction).first()["loss"] == pytest.approx(want, abs=1e-5)


def test_ranks_count_ties_and_odd_values(spark):
    rows = [(1, 0.5, 1), (1, 0.5, 0), (1, 0.7, 0), (1, 0.1, 0), (1, float("nan"), 0)]
    assert evaluate.ranks(spark.createDataFrame(rows, "edge long, score double, label int")).first()["rank"] == 4


def test_metrics(spark):
    got = {r["metric"]: r["value"] for r in evaluate.link_metrics(spark.createDataFrame([(1,), (2,), (4,)], "rank long")).collect()}
    assert got["Hits@1"] == pytest.approx(1 / 3) and got["MRR"] == pytest.approx(7 / 12)


def test_complex_product_and_adagrad(spark):
    row = spark.range(1).select(V.complex_hadamard(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("p"), *train.adagrad(F.array(F.lit(0.5)), F.array(F.lit(0.0)), 0.1)).first()
    assert row[0] == [-5.0, 10.0] and row[1][0] == pytest.approx(-0.1) and row[2] == [0.25]


def test_split_points_and_partitions():
    assert preprocess.split_points(10, (0.8, 0.1, 0.1)) == [8, 9, int(sum((0.8, 0.1, 0.1)) * 10)]
    assert preprocess.partition_size(10, 4) == 3
    with pytest.raises(ValueError):
        preprocess.split_points(10, (1.0,))


def test_gradients_match_finite_differences(spark):
    nodes = [(0, [0.3, -0.2]), (1, [0.5, 0.1]), (2, [-0.4, 0.7])]
    rels = [(0, [0.9, 1.2], [1.0, 1.0])]
    pairs = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 0, 2, 0)], "edge long, src long, rel long, node long, label int")

    def loss(v):
        n = {i: e for i, e in v}
        s = [sum(a * b * c for a, b, c in zip(n[0], rels[0][1], n[k], strict=True)) for k in (1, 2)]
        return math.log(sum(map(math.exp, s))) - s[0]

    tables = spark.createDataFrame(nodes, "id long, emb array<double>"), spark.createDataFrame(rels, "rel long, emb array<double>, inv_emb array<double>")
    scored = train.distmult_scores(pairs, *tables)
    got = {r["id"]: r["g"] for r in train.gradients(scored, *tables)[0].collect()}
    for i in range(3):
        for d in range(2):
            up = [(k, [x + (1e-6 if (k, j) == (i, d) else 0) for j, x in enumerate(e)]) for k, e in nodes]
            down = [(k, [x - (1e-6 if (k, j) == (i, d) else 0) for j, x in enumerate(e)]) for k, e in nodes]
            assert got[i][d] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("decoder", ["DISTMULT", "COMPLEX", "TRANSE"])
def test_score_gradients_match_finite_differences(spark, decoder):
    own = {"e": [0.3, -0.2], "r": [0.9, 1.2], "t": [-0.4, 0.7]}
    rows, step = [own], 1e-6
    for k in own:
        for d in range(2):
            for h in (step, -step):
                rows.append({**own, k: [x + (h if j == d else 0) for j, x in enumerate(own[k])]})
    table = spark.createDataFrame([(i, r["e"], r["r"], r["t"]) for i, r in enumerate(rows)], "i int, e array<double>, r array<double>, t array<double>")
    table = table.withColumn("score", get_decoder(decoder).score(F.col("e"), F.col("r"), F.col("t")))
    got = table.select("score", *train.score_gradients(decoder, F.col("e"), F.col("r"), F.col("t"), F.col("score"))).orderBy("i").collect()
    for k in range(6):
        assert got[0][1 + k // 2][k % 2] == pytest.approx((got[1 + 2 * k]["score"] - got[2 + 2 * k]["score"]) / (2 * step), abs=1e-6)


@pytest.mark.parametrize("name", train.LOSSES)
def test_coefficients_match_finite_differences(spark, name):
    got = {r["node"]: r["coef"] for r in train.coefficients(spark.createDataFrame([(1, k, s, y) for k, (_, s, y) in enumerate(PAIR)], "edge long, node long, score double, label int"), name, "MEAN").collect()}
    for k in range(3):
        up, down = (losses.get_loss(name)(spark.createDataFrame([(e, s + (h if j == k else 0), y) for j, (e, s, y) in enumerate(PAIR)], "edge long, score double, label int"), "MEAN").first()["loss"] for h in (1e-5, -1e-5))
        assert got[k] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_model_trains_both_sides_by_its_own_decoder(spark):
    edges = spark.createDataFrame([(i, i, 0, (i + 1) % 6, "train") for i in range(6)], "edge long, src long, rel long, dst long, split string")
    config = GraphConfig()
    config.model.decoder, config.model.embedding_dim = DecoderType.COMPLEX, 4
    config.training.negatives.negatives_per_positive, config.training.negatives.degree_fraction = 4, 0.5
    model = GraphModel.create(spark, config, edges)
    model.train()
    r = model.tables.relation_embeddings.first()
    assert r["inv_emb"] != [1.0, 1.0, 0.0, 0.0] and r["emb"] != [1.0, 1.0, 0.0, 0.0] and any(r["inv_state"])
    assert r["emb"][2:] != [0.0, 0.0]
    config.training.negatives.method = NegativeMethod.GAN
    model.train()
    assert model.epoch == 2 and model.tables.generator_embeddings.count() == 6
    config.model.decoder = DecoderType.NODE
    with pytest.raises(ValueError):
        model.train()


def test_vectors_of_any_length_are_summed(spark):
    rows = [(k, [float(k + i) for i in range(n)]) for k, n in ((1, 130), (1, 130), (2, 64), (3, 3), (3, 5), (4, 0))] + [(5, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["s"] for r in reduce_vectors(df, "id", "v", "s").collect()}
    assert got == {1: [2.0 * (1 + i) for i in range(130)], 2: [2.0 + i for i in range(64)], 3: [6.0, 8.0, 10.0, 6.0, 7.0], 4: []}
    known = {r["id"]: r["s"] for r in reduce_vectors(df, "id", "v", "s", width=130).collect()}
    assert known == got
    with pytest.raises(Exception, match="longer than 64"):
        reduce_vectors(df, "id", "v", "s", width=64).collect()
    top = {r["id"]: r["s"] for r in reduce_vectors(df, "id", "v", "s", F.max).collect()}
    assert top[1] == [1.0 + i for i in range(130)]


def test_null_elements_are_passed_over_alike(spark):
    df = spark.createDataFrame([(1, [1.0, None, 3.0]), (1, [1.0, None, 3.0]), (2, [None, 4.0]), (2, [5.0])], "id long, v array<double>")
    want = {1: [2.0, None, 6.0], 2: [5.0, 4.0]}
    for width in (None, 3, 200):
        assert {r["id"]: r["s"] for r in reduce_vectors(df, "id", "v", "s", width=width).collect()} == want
