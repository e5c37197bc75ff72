"""Initialisers: vectors as functions of an id, so that a table of any size is made without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.hashing import uniform


def fans(shape: tuple[int, ...]) -> tuple[int, int]:
    """Fan-in and fan-out of a shape; one dimension counts for both."""
    return (shape[0], shape[0]) if len(shape) < 2 else (shape[0], shape[1])


def _cells(ids: Column, width: int, cell) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: cell(F.concat(ids.cast("string"), F.lit("/"), d.cast("string"))))


def uniform_init(ids: Column, width: int, scale: float, salt: str = "init") -> Column:
    return _cells(ids, width, lambda k: (uniform(k, salt) * 2 - 1) * F.lit(scale))


def glorot_uniform(ids: Column, width: int, shape: tuple[int, ...], salt: str = "init") -> Column:
    i, o = fans(shape)
    return uniform_init(ids, width, math.sqrt(6 / (i + o)), salt)


def normal_init(ids: Column, width: int, mean: float, std: float, salt: str = "init") -> Column:
    """Box-Muller on two hash uniforms."""
    return _cells(ids, width, lambda k: F.lit(mean) + F.lit(std) * F.sqrt(-2 * F.log(1 - uniform(k, salt))) * F.cos(F.lit(2 * math.pi) * uniform(k, salt + "2")))


def glorot_normal(ids: Column, width: int, shape: tuple[int, ...], salt: str = "init") -> Column:
    i, o = fans(shape)
    return normal_init(ids, width, 0.0, math.sqrt(2 / (i + o)), salt)


def constant_init(width: int, value: float) -> Column:
    return F.array_repeat(F.lit(float(value)), width)


def initialize(kind: str, ids: Column, width: int, shape: tuple[int, ...] | None = None, **options: float) -> Column:
    """An initialiser by name; a part of a larger tensor uses the fans of the whole ``shape``."""
    shape = shape or (width,)
    kind = kind.upper()
    if kind == "GLOROT_UNIFORM":
        return glorot_uniform(ids, width, shape)
    if kind == "GLOROT_NORMAL":
        return glorot_normal(ids, width, shape)
    if kind == "UNIFORM":
        return uniform_init(ids, width, options.get("scale_factor", 1.0))
    if kind == "NORMAL":
        return normal_init(ids, width, options.get("mean", 0.0), options.get("std", 1.0))
    if kind in ("CONSTANT", "ZEROS", "ONES"):
        return constant_init(width, {"ZEROS": 0.0, "ONES": 1.0}.get(kind, options.get("constant", 0.0)))
    raise ValueError(f"unknown initialisation {kind}")
