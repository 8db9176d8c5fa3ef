"""Rows of prompts and train as (tab, id, text), and small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of prompts and train that hold a text: (tab, id, text)."""
    return all_texts(spark, sf_dir).where(F.col("text").isNotNull())


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of prompts and train, null texts included: (tab, id, text)."""
    prompts = read(spark, sf_dir, "prompts").select(F.lit("prompts").alias("tab"), F.col("prompt_id").alias("id"), "text")
    train = read(spark, sf_dir, "train").select(F.lit("train").alias("tab"), F.col("sample_id").alias("id"), "text")
    return prompts.unionByName(train)


def identified(rows: DataFrame) -> DataFrame:
    """The rows with id and tab: a pair or class can't name others."""
    return rows.where(F.col("id").isNotNull() & F.col("tab").isNotNull())


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` over each Arrow batch. The batches are bounded by the session's Arrow setting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)

    return df.mapInArrow(run, schema)


def digest_columns(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """16-byte digests as two BIGINT arrays."""
    flat = pa.py_buffer(b"".join(digests))
    both = pa.Array.from_buffers(pa.int64(), 2 * len(digests), [None, flat])
    both = both.to_numpy()
    return pa.array(both[::2].copy()), pa.array(both[1::2].copy())


#: A key is hot if it has more than HOT rows, and more than one in MOST_HOT of all rows: so at most MOST_HOT keys are (some 8 MB).
HOT, MOST_HOT = 20_000, 200_000


def salt_join(rows: DataFrame, small: DataFrame, keys: list[str], id_col: str, n_col: str, total: int, hot: int = HOT, part: int = HOT, *, counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``small`` on ``keys``, where ``small.n_col`` counts the rows of the key among ``total``.

    The rows of a hot key are spread over parts of about ``part`` rows by their id, and the rows of ``small`` with that
    key copied to each part, so a task gets some ``part`` rows of a key, however many it has. Only the hot keys are
    broadcast: since each has more than total / MOST_HOT rows, there are fewer than MOST_HOT of them. They are read from ``counts``
    (keys, n_col) where that is given and cheaper than ``small``.
    """
    is_hot = F.col(n_col) > max(hot, total // MOST_HOT)
    parts = F.ceil(F.col(n_col) / part).cast("int")
    hot_keys = (small if counts is None else counts).where(is_hot).groupBy(*keys).agg(F.max(parts).alias("_parts"))
    spread = small.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(-1)))))
    at = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(id_col), F.col("_parts")).cast("int")).otherwise(F.lit(-1))
    marked = rows.join(F.broadcast(hot_keys), keys, "left").withColumn("_part", at).drop("_parts")
    return marked.join(spread, [*keys, "_part"]).drop("_part")


#: Classes that may be broadcast as they are (some 12 MB).
MOST_CLASSES = 300_000


def in_classes(members: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """The members (tab, k_hi, k_lo, ...) of the classes on one side of the pairs; where these are too many to broadcast, all members."""
    of = pairs.select("tab", F.col(f"{side}_hi").alias("k_hi"), F.col(f"{side}_lo").alias("k_lo")).distinct()
    return members.join(F.broadcast(of), ["tab", "k_hi", "k_lo"], "left_semi") if of.count() <= MOST_CLASSES else members
