"""Shards: chunking, length sort, greedy budgets, packing, segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk(rn: Column, size: int) -> Column:
    """The chunk of the row with rank ``rn`` (from 1)."""
    return F.floor((rn - 1) / size).cast("int")


def length_sorted(rows: DataFrame, shard: list[str], length: str, order: str) -> DataFrame:
    """``pos`` (from 0) by ascending length, ties in input order, and ``off``, the lengths before, within each shard.

    A shard holds a bounded number of rows, so the window does too.
    """
    w = Window.partitionBy(*shard).orderBy(length, order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("off", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))


def token_batches(lengths: Column, budget: int, most: int) -> Column:
    """The sizes of the greedy batches over ascending lengths: a batch grows while it has fewer than ``most`` rows and
    (n + 1) * next length fits ``budget``; a row that alone exceeds it is a batch of its own."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        fits = (s.n > 0) & (s.n < most) & ((s.n + 1) * x <= budget)
        closed = F.when(s.n > 0, F.concat(s.done, F.array(s.n))).otherwise(s.done)
        return F.struct(F.when(fits, s.done).otherwise(closed).alias("done"), F.when(fits, s.n + 1).otherwise(F.lit(1)).alias("n"))

    return F.aggregate(lengths, start, step, lambda s: F.when(s.n > 0, F.concat(s.done, F.array(s.n))).otherwise(s.done))


def additive_batches(costs: Column, budget: int) -> Column:
    """As ``token_batches`` with a budget on the sum; an item above it still goes alone."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        fits = (s.n > 0) & (s.sum + x <= budget)
        closed = F.when(s.n > 0, F.concat(s.done, F.array(s.n))).otherwise(s.done)
        return F.struct(
            F.when(fits, s.done).otherwise(closed).alias("done"), F.when(fits, s.n + 1).otherwise(F.lit(1)).alias("n"), F.when(fits, s.sum + x).otherwise(x.cast("bigint")).alias("sum")
        )

    return F.aggregate(costs, start, step, lambda s: F.when(s.n > 0, F.concat(s.done, F.array(s.n))).otherwise(s.done))


def runs(flags: DataFrame, keys: list[str], pos: str, flag: Column) -> DataFrame:
    """(keys, start, len) of each maximal run of flagged positions."""
    w = Window.partitionBy(*keys).orderBy(pos)
    island = flags.where(flag).withColumn("_g", F.col(pos) - F.row_number().over(w))
    return island.groupBy(*keys, "_g").agg(F.min(pos).alias("start"), F.count("*").cast("int").alias("len")).drop("_g")


def segment_positions(segments: DataFrame) -> DataFrame:
    """A row for each position of each segment (start, len): the range join as an equi-join."""
    return segments.where("len > 0").withColumn("pos", F.explode(F.expr("sequence(start, start + len - 1)")))


def visible_to(i: Column, text: Column, n: Column) -> Column:
    """How many of ``n`` positions position ``i`` (from 0) may attend to: those up to itself; text positions, the first ``text``, never see the queries behind."""
    return F.least(F.when(i < text, F.least(i + 1, text)).otherwise(i + 1), n)


def first_starts(counts: Column, base: int = 70, gap: int = 7) -> Column:
    """Where the segments of given lengths begin: the first at ``base``, each next ``gap`` after the end of the one before."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(base).alias("at"))
    step = lambda s, n: F.struct(F.concat(s.out, F.array(s.at)).alias("out"), (s.at + n.cast("int") + gap).alias("at"))
    return F.aggregate(counts, start, step, lambda s: s.out)


def top_groups(scores: DataFrame, token: str, group: str, item: str, score: str, groups: int, items: int) -> DataFrame:
    """Of each token the best ``groups`` groups by the sum of their two best items, of these the best ``items`` items, weights made to sum to 1."""
    w = Window.partitionBy(token, group).orderBy(F.desc(score), item)
    best = scores.withColumn("_k", F.row_number().over(w))
    of_group = best.where("_k <= 2").groupBy(token, group).agg(F.sum(score).alias("_s"))
    kept = of_group.withColumn("_g", F.row_number().over(Window.partitionBy(token).orderBy(F.desc("_s"), group))).where(F.col("_g") <= groups)
    inside = scores.join(kept.select(token, group), [token, group])
    top = inside.withColumn("_k", F.row_number().over(Window.partitionBy(token).orderBy(F.desc(score), item))).where(F.col("_k") <= items).drop("_k")
    return top.withColumn("weight", F.col(score) / F.sum(score).over(Window.partitionBy(token)))
