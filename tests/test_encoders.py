"""Encoders: finite differences through two layers, node classification and encoded link prediction as models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.config import load_config
from graphloom.engine import GraphModel
from graphloom.operators import encoded as N
from graphloom.operators import encoders as E
from graphloom.operators.train import Optim

RNG = np.random.default_rng(11)
EDGES = sorted({(int(a), int(b)) for a, b in zip(RNG.integers(0, 10, 25), RNG.integers(0, 10, 25), strict=True)})
X, Y = RNG.normal(size=(10, 3)), RNG.integers(0, 2, 10)


def graph(spark):
    e = spark.createDataFrame([(i, a, 0, b, "train") for i, (a, b) in enumerate(EDGES)], "edge long, src long, rel long, dst long, split string")
    n = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, emb array<double>")
    return e, n, spark.createDataFrame([(i, int(y)) for i, y in enumerate(Y)], "id long, y int")


def dense(layer, sources):
    """The aggregation as a matrix over all nodes whose neighbours are all expanded."""
    a, d = np.zeros((10, 10)), np.array([sum(s == i for s, _ in EDGES) if i in sources else 0 for i in range(10)])
    for s, t in EDGES:
        if s in sources:
            a[s, t] += 1
    if layer.kind == "SAGE_MEAN":
        return a / np.maximum(d, 1)[:, None]
    a += np.eye(10)
    return a / (d + 1)[:, None] if layer.kind == "SAGE_GCN" else a / np.sqrt((d + 1)[:, None] * (d + 1)[None])


def loss_of(x, weights, layers):
    """Summed class loss of all nodes, by dense matrices."""
    for layer, w in zip(layers, weights, strict=True):
        agg = dense(layer, range(10)) @ x
        pre = (x @ w["w1"].T + agg @ w["w2"].T if layer.kind == "SAGE_MEAN" else agg @ w["w1"].T) + w.get("b", 0)
        x = np.maximum(pre, 0) if layer.activation == "RELU" else 1 / (1 + np.exp(-pre)) if layer.activation == "SIGMOID" else pre
    return float((np.log(np.exp(x).sum(1)) - x[np.arange(10), Y]).sum())


def difference(f, m):
    out = np.zeros_like(m)
    for i in np.ndindex(m.shape):
        kept = m[i]
        m[i] = kept + 1e-6
        up = f()
        m[i] = kept - 1e-6
        out[i] = (up - f()) / 2e-6
        m[i] = kept
    return out


@pytest.mark.parametrize("layers", [
    [E.Layer("SAGE_MEAN", 3, 4, "SIGMOID"), E.Layer("GCN", 4, 2)],
    [E.Layer("SAGE_GCN", 3, 4, "RELU", bias=False), E.Layer("SAGE_MEAN", 4, 2)],
])
def test_two_layers_match_finite_differences(spark, layers):
    e, n, labels = graph(spark)
    p = N.Encoded(n, E.new_weights(spark, layers))
    c = N.EncoderConfig(layers)
    weight_grads, input_grads, loss, _ = N.class_step_gradients(labels, e, p, c)
    weights, x = E.read_weights(p.weights, layers), X.copy()
    assert loss == pytest.approx(loss_of(x, weights, layers)) and c.progress == [{"step": 1, "loss": loss, "nodes": 10}]
    got = {r["param"]: r["g"] for r in weight_grads.collect()}
    for k, w in enumerate(weights):
        for name, m in w.items():
            want = difference(lambda: loss_of(x, weights, layers), m)
            assert np.allclose([got[f"{k}/{name}/{o:06d}"] for o in range(len(m))], want, atol=1e-5)
    inputs = {r["id"]: r["g"] for r in input_grads.collect()}
    assert np.allclose([inputs.get(i, [0.0] * 3) for i in range(10)], difference(lambda: loss_of(x, weights, layers), x), atol=1e-5)


def test_hops_of_few_roots_are_enough(spark):
    """The encoding of one root over its own hops equals its row in the encoding of all nodes."""
    e, n, _ = graph(spark)
    layers = [E.Layer("SAGE_MEAN", 3, 4, "RELU"), E.Layer("SAGE_MEAN", 4, 2)]
    weights = E.read_weights(E.new_weights(spark, layers), layers)
    inputs = n.select("id", F.col("emb").alias("vec"))
    every = {r["id"]: r["g"] for r in E.forward(n.select(F.col("id").alias("node")), e, inputs, layers, weights).output.collect()}
    one = {r["id"]: r["g"] for r in E.forward(spark.createDataFrame([(4,)], "node long"), e, inputs, layers, weights).output.collect()}
    assert list(one) == [4] and np.allclose(one[4], every[4])


def options(task, outputs, **more):
    return load_config({
        "model": {"learning_task": task, "decoder": "NODE" if task == "NODE_CLASSIFICATION" else "DISTMULT", "embedding_dim": 3, "encoder": [{"type": "SAGE", "output_dim": 4, "activation": "RELU"}, {"type": "GCN", "output_dim": outputs}],
                  "dense_optimizer": {"type": "ADAM", "learning_rate": 0.05}},
        "training": {"num_epochs": 2, "batch_size": 30, "negatives": {"negatives_per_positive": 4, "num_chunks": 2}}, **more,
    })


def test_model_classifies_nodes(spark, tmp_path):
    e, _, labels = graph(spark)
    model = GraphModel.create(spark, options("NODE_CLASSIFICATION", 2), e, labels=labels.withColumn("split", F.when(F.col("id") < 8, "train").otherwise("test")))
    model.train()
    assert len(model.progress) == 2 and model.steps == 2 and model.progress[1]["loss"] < model.progress[0]["loss"]
    got = model.evaluate("train").first()["accuracy"]
    assert 0 <= got <= 100
    model.save(str(tmp_path))
    again = GraphModel.create(spark, options("NODE_CLASSIFICATION", 2), e, labels=model.tables.labels)
    again.load(str(tmp_path), 2)
    assert again.evaluate("train").first()["accuracy"] == got and "m" in again.tables.weights.columns


def test_model_trains_links_through_an_encoder(spark):
    e, _, _ = graph(spark)
    config = options("LINK_PREDICTION", 4)
    config.training.num_epochs, config.model.inverse_edges = 1, False
    model = GraphModel.create(spark, config, e)
    before = sorted(map(str, model.tables.weights.select("param", "emb").collect()))
    model.train()
    assert sorted(map(str, model.tables.weights.select("param", "emb").collect())) != before
    assert model.tables.relation_embeddings.where("exists(m, x -> x != 0)").count() == 1
    rows = {r["metric"]: r["value"] for r in model.evaluate("train").collect()}
    assert 1 <= rows["MR"] <= 10


def test_wrong_encoders_and_classes(spark):
    with pytest.raises(ValueError):
        E.Layer("GAT", 3, 2)
    with pytest.raises(ValueError):
        N.EncoderConfig([E.Layer("GCN", 3, 4), E.Layer("GCN", 3, 2)])
    e, n, labels = graph(spark)
    layers = [E.Layer("GCN", 3, 2)]
    p = N.Encoded(n, E.new_weights(spark, layers), steps=0)
    with pytest.raises(Exception, match="classes lie in"):
        N.class_step_gradients(labels.withColumn("y", F.lit(2)), e, p, N.EncoderConfig(layers))
    kept = N.train_classes(labels.limit(0), e, p, N.EncoderConfig(layers, dense=Optim("SGD")))
    assert kept is p
    assert E.concatenated(n, n.withColumnRenamed("emb", "vec")).first()["vec"].__len__() == 6
