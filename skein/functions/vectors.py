"""Vector functions on ARRAY columns, by higher-order functions inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def centred_cosine(a: Column, b: Column, mean: Column) -> Column:
    return cosine(subtract(a, mean), subtract(b, mean))


def rms_norm(v: Column, eps: float = 1e-5) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + eps)
    return F.transform(v, lambda x: x.cast("double") / scale)


def unit(v: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def standardise(v: Column, mean: Column, sigma: Column) -> Column:
    return F.zip_with(subtract(v, mean), sigma, lambda x, s: x / s)


def unstandardise(v: Column, mean: Column, sigma: Column) -> Column:
    return F.zip_with(F.zip_with(v, sigma, lambda x, s: x.cast("double") * s), mean, lambda x, m: x + m)


def linear(v: Column, rows: Sequence[Sequence[float]], bias: Sequence[float] | None = None) -> Column:
    """v times the transpose of a small constant matrix."""
    out = F.array(*(dot(v, F.array(*map(F.lit, map(float, r)))) for r in rows))
    return F.zip_with(out, F.array(*map(F.lit, map(float, bias))), lambda x, b: x + b) if bias else out


def pad(v: Column, length: Column, value: Column) -> Column:
    """``v`` cut or filled to ``length``."""
    return F.slice(F.concat(v, F.array_repeat(value, F.greatest(length - F.size(v), F.lit(0)))), F.lit(1), length)


def mask(length: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda p: p < length)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
