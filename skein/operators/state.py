"""State queries: manifests, completeness, logs, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(expected: DataFrame, there: DataFrame) -> DataFrame:
    """Expected files with ``ok``: the path is there, and its size is as expected or none is."""
    got = expected.join(there.withColumnRenamed("size", "found"), "path", "left")
    return got.withColumn("ok", F.coalesce((F.col("size") == 0) | (F.col("found") == F.col("size")), F.lit(False)) & F.col("found").isNotNull())


def completeness(files: DataFrame, first: int = 8) -> DataFrame:
    """Of each material: files, files present, bytes in all and done, and the first missing paths."""
    w = Window.partitionBy("material").orderBy("path")
    # The limit of the rank is applied in each task before the shuffle, so a material brings ``first`` rows a task.
    listed = files.where(~F.col("ok")).select("material", "path").withColumn("k", F.row_number().over(w)).where(F.col("k") <= first)
    missing = listed.groupBy("material").agg(F.array_sort(F.collect_list("path")).alias("missing"))
    sums = files.groupBy("material").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("n_present"), F.sum("size").alias("total"),
        F.least(F.coalesce(F.sum(F.when(F.col("ok"), F.col("size"))), F.lit(0)), F.sum("size")).alias("done"), F.bool_and("ok").alias("complete"),
    )
    return sums.join(missing, "material", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))


def exports_of(files: DataFrame, name: str, suffix: str = ".gguf") -> DataFrame:
    """The files (name, ...) that a project of this name exported: those of its base name and an underscore."""
    return files.where(F.col("name").startswith(name.removesuffix("_adapter") + "_") & F.col("name").endswith(suffix))


def preferred(value: str, wanted: Column, order: Column) -> Column:
    """The first value of a group, or the first that is wanted if there is one."""
    return F.max_by(value, F.struct(wanted, -order))


def headline(values: Column, named: Column, order: tuple[str, ...], hidden: tuple[str, ...] = ("time",)) -> Column:
    """The keys of a map of numbers that are shown: of ``named`` those that have a value; if none has, all others in ``order`` that aren't hidden."""
    own = F.filter(named, lambda k: F.element_at(values, k).isNotNull())
    rest = F.filter(F.array(*(F.lit(k) for k in order if k not in hidden)), lambda k: F.element_at(values, k).isNotNull())
    return F.when(F.size(own) > 0, own).otherwise(rest)


def upsert(manifest: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The manifest with the rows of ``new`` in the place of those of the same key."""
    return manifest.join(new.select(key), key, "left_anti").unionByName(new)


def carried(col: str, w: Window) -> Column:
    """The last value that is neither null nor NaN, this row's included."""
    known = F.when(~F.isnan(col), F.col(col))
    return F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def running_best(col: Column, w: Window) -> tuple[Column, Column]:
    """(best so far, whether this row is strictly better than all before)."""
    before = F.max(col).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.greatest(before, col), col.isNotNull() & (before.isNull() | (col > before))


def status(state: Column, alive: Column) -> Column:
    """A terminal status stands; running without a live process is interrupted."""
    return F.when(state.isin("done", "failed", "stopped"), state).when((state == "running") & ~alive, "interrupted").otherwise(F.coalesce(state, F.lit("idle")))


def thinned(rows: DataFrame, rn: str, n: str, most: int) -> DataFrame:
    """At most about ``most`` rows at even steps of the rank (from 1), and always the last."""
    i = F.col(rn) - 1
    step = F.greatest(F.lit(1.0), F.col(n) / float(most))
    k = F.ceil(i / step)
    return rows.where((F.floor(k * step) == i) | (F.col(rn) == F.col(n)))
