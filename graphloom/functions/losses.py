"""Losses over score tables: one row per scored pair with (edge, score, label); label 1 marks the positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

REDUCTIONS = ("SUM", "MEAN")


def sigmoid(s: Column) -> Column:
    return 1 / (1 + F.exp(-s))


def reduced(value: Column, reduction: str) -> Column:
    if reduction.upper() not in REDUCTIONS:
        raise ValueError(f"unknown reduction {reduction}")
    return (F.sum if reduction.upper() == "SUM" else F.avg)(value)


def _per_edge_lse(scores: DataFrame) -> DataFrame:
    """(edge, pos, lse): the positive's score and the stable log of the sum of all exponentials, one aggregation each."""
    top = scores.groupBy("edge").agg(F.max("score").alias("top"))
    both = scores.join(top, "edge")
    return both.groupBy("edge").agg(F.max(F.when(F.col("label") == 1, F.col("score"))).alias("pos"), (F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("lse"))


def softmax_ce(scores: DataFrame, reduction: str = "SUM") -> DataFrame:
    return _per_edge_lse(scores).agg(reduced(F.col("lse") - F.col("pos"), reduction).alias("loss"))


cross_entropy = softmax_ce


def ranking(scores: DataFrame, reduction: str = "SUM", margin: float = 0.1) -> DataFrame:
    """max(0, negative - positive + margin) over every pair of an edge."""
    pos = scores.where("label = 1").select("edge", F.col("score").alias("pos"))
    return scores.where("label = 0").join(pos, "edge").agg(reduced(F.greatest(F.lit(0.0), F.col("score") - F.col("pos") + F.lit(margin)), reduction).alias("loss"))


def _pointwise(value):
    def loss(scores: DataFrame, reduction: str = "SUM") -> DataFrame:
        return scores.agg(reduced(value(F.col("score"), F.col("label")), reduction).alias("loss"))

    return loss


#: Losses of one score and its label.
POINTWISE = {
    "BCE_AFTER_SIGMOID": lambda s, y: -(y * F.greatest(F.log(sigmoid(s)), F.lit(-100.0)) + (1 - y) * F.greatest(F.log(1 - sigmoid(s)), F.lit(-100.0))),
    "BCE_WITH_LOGITS": lambda s, y: F.greatest(s, F.lit(0.0)) - s * y + F.log1p(F.exp(-F.abs(s))),
    "MSE": lambda s, y: (s - y) * (s - y),
    "SOFTPLUS": lambda s, y: F.greatest(-(2 * y - 1) * s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))),
}
bce_after_sigmoid, bce_with_logits, mse, softplus = (_pointwise(POINTWISE[n]) for n in ("BCE_AFTER_SIGMOID", "BCE_WITH_LOGITS", "MSE", "SOFTPLUS"))

LOSSES = {"SOFTMAX_CE": softmax_ce, "RANKING": ranking, "CROSS_ENTROPY": cross_entropy, "BCE_AFTER_SIGMOID": bce_after_sigmoid, "BCE_WITH_LOGITS": bce_with_logits, "MSE": mse, "SOFTPLUS": softplus}


def log_sum(scores: Column, *more: Column) -> Column:
    """The stable log of the sum of the exponentials of an array's elements and of further scores."""
    top = F.greatest(*more, F.array_max(scores)) if more else F.array_max(scores)
    first = sum((F.exp(m - top) for m in more), F.lit(0.0))
    return F.log(F.aggregate(scores, first, lambda a, s: a + F.exp(s - top))) + top


def packed_loss(name: str, margin: float = 0.1):
    """A loss by name over rows (score, scores): an edge's own score and its negatives'. No edge's pairs are brought together again.

    Rows that come as a list are summed one after another, and the sums written.
    """
    name, s = name.upper(), F.col("score")
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}")
    over = lambda f: F.aggregate("scores", F.lit(0.0), lambda a, n: a + f(n))
    if name in POINTWISE:
        value, terms = POINTWISE[name](s, F.lit(1)) + over(lambda n: POINTWISE[name](n, F.lit(0))), F.size("scores") + 1
    elif name == "RANKING":
        value, terms = over(lambda n: F.greatest(F.lit(0.0), n - s + F.lit(margin))), F.size("scores")
    else:
        value, terms = log_sum(F.col("scores"), s) - s, F.lit(1)

    def loss(packed: DataFrame | list[DataFrame], reduction: str = "SUM") -> DataFrame:
        reduced(s, reduction)  # an unknown reduction raises
        parts = [p.agg(F.sum(value).alias("loss"), F.sum(terms).alias("n")) for p in (packed if isinstance(packed, list) else [packed])]
        found = parts[0] if len(parts) == 1 else materialize(parts[0], "losses", *parts[1:]).agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        empty = F.lit(None) if name == "RANKING" or reduction.upper() == "MEAN" else F.col("loss")
        whole = F.col("loss") if reduction.upper() == "SUM" else F.col("loss") / F.col("n")
        return found.select(F.when(F.col("n") == 0, empty).otherwise(whole).alias("loss"))

    return loss


def get_loss(name: str):
    """A loss by name, whatever its case."""
    try:
        return LOSSES[name.upper()]
    except KeyError:
        raise ValueError(f"unknown loss {name}") from None


def class_cross_entropy(logits: DataFrame, reduction: str = "SUM") -> DataFrame:
    """Cross entropy of class logits: rows (id, y, logits array), y the class."""
    top = F.array_max("logits")
    lse = F.log(F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x - top))) + top
    return logits.agg(reduced(lse - F.get("logits", F.col("y")), reduction).alias("loss"))


def norm_regularizer(vectors: DataFrame, coef: float) -> DataFrame:
    """coef / 2 times the sum over dimensions of the column norms of each side; rows (side, vec)."""
    cells = vectors.select("side", F.posexplode("vec").alias("pos", "x"))
    norms = cells.groupBy("side", "pos").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return norms.agg((F.sum("n") * F.lit(coef / 2)).alias("loss"))
