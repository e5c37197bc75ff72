"""Vector expressions over array columns, the relation operators, comparators and activations built from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0.0)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def total(a: Column) -> Column:
    return F.aggregate(a, zero(), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def half(a: Column, second: bool) -> Column:
    """First or second half of an even-length vector."""
    n = (F.size(a) / 2).cast("int")
    return F.slice(a, n + 1 if second else F.lit(1), n)


def columns(a: Column, offset: int, width: int) -> Column:
    """Columns offset to offset + width, as an embedding or feature layer takes them."""
    return F.slice(a, offset + 1, width)


# Relation operators.
def hadamard(e: Column, r: Column) -> Column:
    return multiply(e, r)


def complex_hadamard(e: Column, r: Column) -> Column:
    """Complex product; the first half of a vector is real, the second imaginary."""
    a, b, c, d = half(e, False), half(e, True), half(r, False), half(r, True)
    return F.concat(subtract(multiply(a, c), multiply(b, d)), add(multiply(a, d), multiply(b, c)))


def translation(e: Column, r: Column) -> Column:
    return add(e, r)


def no_op(e: Column, r: Column) -> Column:
    return e


# Comparators.
def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; the sum of squares is kept at 1e-8 or more."""
    d = subtract(a, b)
    return F.sqrt(F.greatest(dot(d, d), F.lit(1e-8)))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, zero()).otherwise(dot(a, b) / n)


def cosine_compat(a: Column, b: Column) -> Column:
    """The compatible form: a plain dot product."""
    return dot(a, b)


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {"hadamard": hadamard, "complex_hadamard": complex_hadamard, "translation": translation, "no_op": no_op}
COMPARATORS: dict[str, Callable[[Column, Column], Column]] = {"dot": dot, "l2": l2, "cosine": cosine, "cosine_compat": cosine_compat}


def activation(a: Column, kind: str) -> Column:
    """RELU, SIGMOID or NONE, elementwise."""
    if kind.upper() == "RELU":
        return F.transform(a, lambda x: F.greatest(x, zero()))
    if kind.upper() == "SIGMOID":
        return F.transform(a, lambda x: 1 / (1 + F.exp(-x)))
    if kind.upper() == "NONE":
        return a
    raise ValueError(f"unknown activation {kind}")


def post_hook(a: Column, bias: Column | None, kind: str) -> Column:
    """Bias once, if there is one, then the activation."""
    return activation(a if bias is None else add(a, bias), kind)


def linear(a: Column, weights: list[list[float]]) -> Column:
    """W a for a literal matrix, the weights being part of the plan."""
    return F.array(*[dot(a, F.array(*[F.lit(float(w)) for w in row])) for row in weights])
