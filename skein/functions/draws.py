"""Random draws as functions of a seed and a key: the same on every engine, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *parts: Column) -> Column:
    """A permutation key: rows sorted by it are shuffled."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def uniform(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 1): the first 13 hexadecimal digits of SHA-1, as many bits as a double holds."""
    digits = F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / 4503599627370496.0


def choice(values: Column, u: Column) -> Column:
    """One element of an array, by a uniform draw; null for an empty one."""
    return F.get(values, F.floor(u * F.size(values)).cast("int"))


def ladder(u: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """Categories with cumulative bounds."""
    out = F.lit(last)
    for bound, name in reversed(steps):
        out = F.when(u < bound, F.lit(name)).otherwise(out)
    return out
