"""Mergeable moments, Gram matrices and the small solves that follow them on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import vectors


def partial_moments(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, dim, s, s2, n): sums of the values and their squares."""
    x = rows.select(*keys, F.posexplode(vector).alias("dim", "x"))
    v = F.col("x").cast("double")
    return x.groupBy(*keys, "dim").agg(F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.count("x").alias("n"))


def merged_moments(partial: DataFrame, floor: float = 1e-3) -> DataFrame:
    """(dim, mean, var, sigma, inv): partial moments merged; the variance is of the population, at least 1e-6."""
    g = partial.groupBy("dim").agg(F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("n").alias("n"))
    mean = F.col("s") / F.col("n")
    var = F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(1e-6))
    return g.select("dim", mean.alias("mean"), var.alias("var"), F.sqrt(var).alias("sigma"), (1.0 / F.greatest(F.sqrt(var), F.lit(floor))).alias("inv"), "n")


def moment_arrays(merged: DataFrame) -> DataFrame:
    """One row (mu, sd) of arrays by dimension: as many values as dimensions, so it may be broadcast."""
    return merged.groupBy().agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "sigma"))).alias("a")).select(F.col("a.mean").alias("mu"), F.col("a.sigma").alias("sd"))


def gram(rows: DataFrame, left: str, right: str | None = None) -> DataFrame:
    """(i, j, value) of the matrix left^T right, in double precision.

    A task multiplies each Arrow batch as a whole and keeps one sum; what is moved is that one matrix a task, a row of it a record,
    and not the products of each vector. Rows in which a vector is null add nothing; vectors of different lengths are an error.
    """
    right = right or left
    pairs = rows.select(F.col(left).cast("array<double>").alias("a"), F.col(right).cast("array<double>").alias("b")).where("a is not null and b is not null")

    def as_matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                part = as_matrix(b.column("a")).T @ as_matrix(b.column("b"))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column("i").to_pylist(), as_matrix(b.column("row")) if b.num_rows else ()):
                sums[i] = sums[i] + row if i in sums else row
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])

    partial = pairs.mapInArrow(multiply, "i int, row array<double>")
    return partial.repartition("i").mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "value"))


def matrix(cells: DataFrame) -> np.ndarray:
    """A (dims x dims) matrix of cells on the driver."""
    pdf = cells.toPandas()
    out = np.zeros((int(pdf["i"].max()) + 1, int(pdf["j"].max()) + 1))
    out[pdf["i"], pdf["j"]] = pdf["value"]
    return out


def principal_components(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, k components as rows, part of the variance kept) from the centred covariance."""
    n = rows.count()
    m = merged_moments(partial_moments(rows, [], vector)).orderBy("dim").toPandas()
    mean = m["mean"].to_numpy()
    cov = matrix(gram(rows, vector)) / n - np.outer(mean, mean)
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    top = vecs[:, order].T
    top *= np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
    return mean, top, float(values[order].sum() / values.sum())


def ridge(rows: DataFrame, x: str, y: str, penalty: float = 1e-4) -> np.ndarray:
    """W of the least squares x W = y with penalty * mean diagonal on the normal equations."""
    g, b = matrix(gram(rows, x)), matrix(gram(rows, x, y))
    return np.linalg.solve(g + penalty * np.trace(g) / len(g) * np.eye(len(g)), b)


def paired_rows(rows: DataFrame, x: str, y: str, queries: int) -> DataFrame:
    """(x, y) of every row of x in the arrays of rows x and y: with the ``queries`` rows of its y one after another, so a map has
    a part for each; with 0 queries, where both have a row a word, with the row of y at the same place."""
    if queries:
        return rows.select(F.explode(x).alias("_x"), F.flatten(y).alias("_y")).select(vectors.doubles(F.col("_x")).alias(x), vectors.doubles(F.col("_y")).alias(y))
    both = rows.select(F.explode(F.arrays_zip(F.col(x).alias("a"), F.col(y).alias("b"))).alias("r"))
    return both.select(vectors.doubles(F.col("r.a")).alias(x), vectors.doubles(F.col("r.b")).alias(y))


def split_rows(rows: DataFrame, names: list[str], queries: int) -> DataFrame:
    """The vectors ``names``, each cut into ``queries`` parts, a row a part."""
    size = (F.size(names[0]) / queries).cast("int")
    cut = rows.select(*names, size.alias("_n"), F.explode(F.sequence(F.lit(0), F.lit(queries - 1))).alias("_q"))
    return cut.select(*(F.slice(c, F.col("_q") * F.col("_n") + 1, F.col("_n")).alias(c) for c in names))


def fold_affine(weights: np.ndarray, bias: np.ndarray, mean: np.ndarray, sigma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias that give the unstandardised output at once."""
    return sigma[:, None] * weights, sigma * bias + mean


def masked_loss(pred: Column, target: Column, sigma: Column) -> Column:
    """Sum over the dimensions of ((p - t) / sigma) squared."""
    return vectors.total(F.zip_with(vectors.subtract(pred, target), sigma, lambda d, s: (d / s) * (d / s)))


def paired_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Row i of one table with row i of the other (suffix ``_r``); tables of different sizes are an error."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"tables of {n} and {m} rows can't be paired")
    return left.join(right.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c != key}), key)
