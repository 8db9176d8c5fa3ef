"""Corpus preparation: pools from ordered sources, first-wins deduplication, seeded splits, blanks and synthesis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import draws, text
from skein.operators.ranking import ranked

LEAST, MOST = 8, 1200


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """(src_ord, row_ord, text) of all sources, in their order; each must have row_ord and text."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(F.lit(i).alias("src_ord"), F.col("row_ord").cast("bigint").alias("row_ord"), "text")
        out = part if out is None else out.unionByName(part)
    return out


def normalised(rows: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Texts with single blanks, of a length within the bounds (both included); null texts fall out."""
    return rows.withColumn("text", text.normalise(F.col("text"))).where(F.length("text").between(least, most))


def first_wins(rows: DataFrame, key: Column | None = None, order: tuple[str, ...] = ("src_ord", "row_ord")) -> DataFrame:
    """One row for each key, the first by ``order``.

    A minimum is merged before the shuffle, so a key that holds a third of all rows is no hot spot (a window would be one).
    """
    rest = [c for c in rows.columns if c not in order]
    first = F.min(F.struct(*order, *rest)).alias("r")
    got = rows.groupBy((F.lower("text") if key is None else key).alias("_key")).agg(first).select("r.*")
    return got.select(*rows.columns)


def pool(sources: list[DataFrame], least: int = LEAST, most: int = MOST) -> DataFrame:
    return first_wins(normalised(union_sources(sources), least, most))


def check_size(n: int, n_val: int, spare: int) -> None:
    """A pool must hold ``spare`` texts more than are held out (100 for texts, 8 for images)."""
    if n < n_val + spare:
        raise ValueError(f"the pool is too small for {n_val} held-out texts")


def checked_length(rows: DataFrame, column: str, most: int, key: str) -> DataFrame:
    """The rows; one whose ``column`` is longer than ``most`` fails the job with its key and how it begins."""
    says = F.concat(F.lit("too long: "), F.col(key).cast("string"), F.lit(" has "), F.length(column).cast("string"), F.lit(" characters: "), text.preview(F.col(column)))
    return rows.withColumn(column, F.when(F.length(column) > most, F.raise_error(says)).otherwise(F.col(column)))


def head_split(rows: DataFrame, n_val: int, n_train: int, seed: int | str, key: str) -> DataFrame:
    """``split`` and ``rn``: the first ``n_val`` rows of the seeded order are val, the next ``n_train`` train; fewer are allowed."""
    keyed = rows.withColumn("_order", draws.order_key(seed, F.col(key)))
    rn = ranked(keyed, ["_order", key]).drop("_order")
    return rn.where(F.col("rn") <= n_val + n_train).withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train"))


def blank_tail(rows: DataFrame, n: int, fraction: float, at_least: int = 0) -> DataFrame:
    """The last rows (by ``rn`` of ``n``) as empty texts: int(n * fraction) of them, at least ``at_least`` if the fraction is positive."""
    k = max(at_least, int(n * fraction)) if fraction > 0 else 0
    return rows.withColumn("text", F.when(F.col("rn") > n - k, "").otherwise(F.col("text")))


def subjects(captions: Column) -> Column:
    """The sorted different subjects of a list of captions, without the one of captions that name none."""
    named = F.filter(F.coalesce(captions, F.array().cast("array<string>")), lambda c: F.coalesce(F.trim(c), F.lit("")) != "")
    return F.array_sort(F.filter(F.array_distinct(F.transform(named, text.subject)), lambda s: s != "subject"))


# Words of the instruction patterns, our own.
STYLES = ["a woodcut", "a pencil sketch", "a watercolour", "a mosaic", "an old postcard"]
PLACES = ["a harbour at night", "an empty desert", "a crowded market", "a snowy street"]
COLOURS = ["red", "teal", "golden", "pale grey"]
THINGS = ["a lantern", "a small dog", "a paper kite", "a bicycle"]
KINDS = [(0.05, "blank"), (0.30, "caption"), (0.45, "add"), (0.55, "remove"), (0.65, "replace"), (0.75, "restyle"), (0.85, "background"), (0.90, "recolour"), (0.95, "styled")]


def instruction(caption: Column, subject: Column, kind: Column, u: Column) -> Column:
    """An edit instruction of a kind, with words chosen by a second draw."""
    pick = lambda words: draws.choice(F.array(*map(F.lit, words)), u)
    of = F.concat(F.lit("the "), F.coalesce(subject, F.lit("subject")))
    return (
        F.when(kind == "blank", "").when(kind == "caption", caption)
        .when(kind == "add", F.concat(F.lit("Add "), pick(THINGS), F.lit(" next to "), of))
        .when(kind == "remove", F.concat(F.lit("Take away "), of))
        .when(kind == "replace", F.concat(F.lit("Swap "), of, F.lit(" for "), pick(THINGS)))
        .when(kind == "restyle", F.concat(F.lit("Turn it into "), pick(STYLES)))
        .when(kind == "background", F.concat(F.lit("Put "), of, F.lit(" in "), pick(PLACES)))
        .when(kind == "recolour", F.concat(F.lit("Make "), of, F.lit(" "), pick(COLOURS)))
        .when(kind == "styled", F.concat(caption, F.lit(", as "), pick(STYLES)))
        .otherwise(text.first_words(caption, F.lit(4)))
    )


def round_robin(pool_: DataFrame, n: int, size: int) -> DataFrame:
    """``i`` in 0..n-1 with the pool row of rank i % size (``rn`` counts from 1)."""
    spark = pool_.sparkSession
    if not size:
        return pool_.limit(0).withColumn("i", F.lit(0).cast("bigint"))
    return spark.range(n).withColumnRenamed("id", "i").withColumn("rn", F.col("i") % size + 1).join(pool_, "rn")


def random_pairs(n: int, size: int, seed: int | str, spark) -> DataFrame:
    """(i, a, b): two different ranks below ``size`` for each i; pairs may repeat. None if there are fewer than two."""
    rows = spark.range(n if size > 1 else 0).withColumnRenamed("id", "i")
    a = F.floor(draws.uniform(f"{seed}a", F.col("i")) * size)
    b = F.floor(draws.uniform(f"{seed}b", F.col("i")) * (size - 1))
    return rows.withColumn("a", a).withColumn("b", b + F.when(b >= F.col("a"), 1).otherwise(0))
