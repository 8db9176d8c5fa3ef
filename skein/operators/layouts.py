"""Shard layouts: ragged arrays of the samples of a shard packed one after another, and unpacked again by offset.

A layout names its columns. A sample is a row (shard, place, columns); a packed shard is a row with, for each ragged column ``c``, ``c_pack``
(all values in the order of the places), ``c_len`` and ``c_off``. Shards hold a bounded number of samples, so a packed one fits a task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Ragged columns, columns with a value a sample, and values of columns that an older shard doesn't have."""

    name: str
    ragged: tuple[str, ...]
    single: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()


#: A fixed number of target rows a text; ids with a row each; positions with image segments, whose targets are left out and whose own rows stand in ``v``.
FIXED = Layout("fixed", ("t",), ("text",))
SEEDED = Layout("seeded", ("ids", "t"), ("text",), (("seed", "0"),))
ALIGNED = Layout("aligned", ("ids", "t", "v", "starts", "lens"), ("text",), (("v_pack", "array()"), ("v_len", "transform(ids_len, x -> 0)"), ("v_off", "transform(ids_len, x -> 0)"), ("t_sparse", "false")))
LAYOUTS = {x.name: x for x in (FIXED, SEEDED, ALIGNED)}


def _offsets(lens: Column) -> Column:
    """Sums of the lengths before each."""
    step = lambda s, n: F.struct(F.concat(s.out, F.array(s.at)).alias("out"), (s.at + n).alias("at"))
    return F.aggregate(lens, F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("at")), step, lambda s: s.out)


def pack(rows: DataFrame, layout: Layout, shard: tuple[str, ...] = ("shard",), place: str = "place") -> DataFrame:
    """A row a shard; null arrays are empty ones."""
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c])).alias(c)
    each = F.struct(place, *map(empty, layout.ragged), *layout.single)
    g = rows.groupBy(*shard).agg(F.array_sort(F.collect_list(each)).alias("s"))
    out = g.select(*shard, F.size("s").alias("n"), *(F.col(f"s.{c}").alias(c) for c in layout.single), *(F.col(f"s.{c}").alias(f"_{c}") for c in layout.ragged))
    for c in layout.ragged:
        out = out.withColumn(f"{c}_pack", F.flatten(f"_{c}")).withColumn(f"{c}_len", F.transform(f"_{c}", lambda x: F.size(x).cast("bigint"))).drop(f"_{c}")
    return out.select("*", *(_offsets(F.col(f"{c}_len")).alias(f"{c}_off") for c in layout.ragged))


def with_defaults(shards: DataFrame, layout: Layout) -> DataFrame:
    """Shards with the columns that older ones don't have."""
    missing = {c: F.expr(sql) for c, sql in layout.defaults if c not in shards.columns}
    return shards.withColumns(missing) if missing else shards


def unpack(shards: DataFrame, layout: Layout, shard: tuple[str, ...] = ("shard",)) -> DataFrame:
    """A row a sample again, ``pos`` from 0; each array is a slice of its pack."""
    at = with_defaults(shards, layout).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    cut = lambda c: F.slice(f"{c}_pack", (F.get(f"{c}_off", F.col("pos")) + 1).cast("int"), F.get(f"{c}_len", F.col("pos")).cast("int")).alias(c)
    return at.select(*shard, "pos", *map(cut, layout.ragged), *(F.get(c, F.col("pos")).alias(c) for c in layout.single))


def without_segments(rows: Column, starts: Column, lens: Column) -> Column:
    """The target rows that are under no segment (sparse targets)."""
    under = lambda i: F.exists(F.arrays_zip(starts.alias("s"), lens.alias("l")), lambda x: (i >= x["s"]) & (i < x["s"] + x["l"]))
    return F.transform(F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), (~under(i)).alias("k"))), lambda x: x.k), lambda x: x.r)


def spliced(rows: Column, starts: Column, lens: Column, other: Column) -> Column:
    """The rows with those under the segments replaced, in order, by the rows of ``other``."""
    before = lambda i: F.aggregate(F.arrays_zip(starts.alias("s"), lens.alias("l")), F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.lit(0), F.least(x["l"].cast("bigint"), i - x["s"])))
    under = lambda i: F.exists(F.arrays_zip(starts.alias("s"), lens.alias("l")), lambda x: (i >= x["s"]) & (i < x["s"] + x["l"]))
    return F.transform(rows, lambda r, i: F.when(under(i), F.get(other, before(i).cast("int"))).otherwise(r))
