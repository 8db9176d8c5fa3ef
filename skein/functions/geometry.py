"""Image sizes, slots and positions; Python's round-half-even is ``bround``, sizes in float32 where the model is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_multiple(x: Column, factor: int) -> Column:
    return F.greatest(F.bround(x / factor).cast("int") * factor, F.lit(factor))


def edit_size(w: Column, h: Column, longest: int = 384, factor: int = 32) -> tuple[Column, Column]:
    """Scaled down so that the longer side is at most ``longest``, then to multiples of ``factor``."""
    scale = F.least(F.lit(1.0).cast("float"), (F.lit(longest).cast("float") / F.greatest(w, h).cast("float")).cast("float"))
    side = lambda x: to_multiple(F.floor((x.cast("float") * scale).cast("float")), factor)
    return side(w), side(h)


def area_size(w: Column, h: Column, area: Column, factor: int = 32) -> tuple[Column, Column]:
    width = F.sqrt(F.floor(area * w / h))
    return to_multiple(width, factor), to_multiple(width * h / w, factor)


def smart_size(w: Column, h: Column, factor: int = 28, least: int = 56 * 56, most: int = 1280 * 784) -> tuple[Column, Column]:
    """To multiples of ``factor``, within [least, most] pixels, the ratio kept."""
    rw, rh = to_multiple(w, factor), to_multiple(h, factor)
    down, up = F.sqrt(w * h / F.lit(float(most))), F.sqrt(F.lit(float(least)) / (w * h))
    low = lambda x: F.greatest(F.floor(x / down / factor) * factor, F.lit(factor)).cast("int")
    high = lambda x: (F.ceil(x * up / factor) * factor).cast("int")
    pick = lambda r, x: F.when(rw * rh > most, low(x)).when(rw * rh < least, high(x)).otherwise(r)
    return pick(rw, w), pick(rh, h)


#: Pixels of the loader (least, most) and of the vision tower (one area).
LOADER, TOWER = (4 * 28 * 28, 1024 * 28 * 28), 672 * 672


def vision_size(w: Column, h: Column, factor: int = 28, loader: tuple[int, int] = LOADER, tower: int = TOWER) -> tuple[Column, Column]:
    """The smart size of the loader, and of its result that of the tower, which has one area; both keep the ratio."""
    w1, h1 = smart_size(w, h, factor, *loader)
    return smart_size(w1, h1, factor, tower, tower)


def slots(w: Column, h: Column, cell: int = 32) -> Column:
    return F.floor(w / cell).cast("int") * F.floor(h / cell).cast("int")


def nearest(n_out: Column, n_in: Column) -> Column:
    """For each output place the input place that is taken."""
    return F.transform(F.sequence(F.lit(0), n_out - 1), lambda i: F.floor(i * n_in / n_out).cast("int"))


def learning_rate(step: Column, warm: int, total: int, base: float) -> Column:
    """Linear warm-up, then a cosine down to a tenth."""
    t = F.least((step - warm) / float(max(1, total - warm)), F.lit(1.0))
    return F.when(step < warm, F.lit(base) * (step + 1) / warm).otherwise(F.lit(base) * (0.1 + 0.45 * (1 + F.cos(F.lit(3.141592653589793) * t))))


def axis_angles(at: Column, n: int, interleaved: int, base: float = 10000.0) -> Column:
    """(place, angle) for each of ``n`` frequencies: places of the axes (time, height, width) by turns up to 3 * ``interleaved``, then time alone."""
    axis = lambda i: F.when(i < 3 * interleaved, i % 3).otherwise(0)
    place = lambda i: F.get(at, axis(i).cast("int")).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(place(i).alias("place"), (place(i) * F.pow(F.lit(base), -i / float(n))).alias("angle")))
