"""Queries on batch order, incremental shards and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import encoders, layouts, stats
from skein.operators.ranking import ranked
from skein.operators.shards import chunk
from skein.plans.registry import query, table
from skein.plans.shard_queries import ROWS, rows
from skein.session import Written
from skein.streaming import batches

_ORDER = ROWS + """, e AS (SELECT DISTINCT split, shard, epoch FROM rows, range(0, 2) t(epoch)), s AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY md5('8|' || epoch || '|' || split || '|' || shard), split, shard) - 1 AS shard_i FROM e),
o AS (SELECT epoch::INT AS epoch, r.split, r.shard, r.pos::INT AS pos, shard_i, row_number() OVER (PARTITION BY epoch, r.split, r.shard ORDER BY md5('8|' || epoch || '|' || r.split || '|' || r.shard || '|' || r.pos), r.pos) - 1 AS place FROM rows r JOIN s ON r.split = s.split AND r.shard = s.shard)
"""


def order(spark, d):
    return batches.epoch_order(rows(spark, d).select("split", "shard", "pos"), 2, 32, 8)


@query("epoch_order", _ORDER + "SELECT epoch, split, shard, pos, shard_i, place, (place // 32)::INT AS batch_i FROM o")
def _(spark, d):
    return order(spark, d).select("epoch", "split", "shard", "pos", F.col("shard_i").cast("bigint").alias("shard_i"), F.col("place").cast("bigint").alias("place"), "batch_i")


@query("resumed_order", _ORDER + "SELECT epoch, shard_i, (place // 32)::INT AS batch_i, count(*) AS n, min(pos) AS least FROM o WHERE epoch > 0 OR (epoch = 0 AND (shard_i > 3 OR (shard_i = 3 AND place // 32 >= 2))) GROUP BY ALL")
def _(spark, d):
    o = order(spark, d).where(batches.after(0, 3, 2))
    return o.groupBy("epoch", F.col("shard_i").cast("bigint").alias("shard_i"), "batch_i").agg(F.count("*").alias("n"), F.min("pos").alias("least"))


@query("shards_taken_in", "SELECT split, shard, len(prompts)::BIGINT AS n, stat_n FROM shards")
def _(spark, d):
    """The shard table arrives as files, is taken in by an available-now stream, twice, and read back."""
    out = Written(spark, "stream")
    src = table(spark, d, "shards")
    out.table(src.repartition(6, "split", "shard"), "in")
    for _ in range(2):  # the second run finds nothing new
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
        batches.take_in(spark, f"{out.root}/in", schema, f"{out.root}/out", f"{out.root}/state", ["split", "shard"])
    return spark.read.schema(src.schema).parquet(f"{out.root}/out").select("split", "shard", F.size("prompts").cast("bigint").alias("n"), "stat_n")


@query("static_validation", "SELECT split, count(*) AS n, min(sample_id) AS first, max(sample_id) AS last FROM val GROUP BY split")
def _(spark, d):
    return table(spark, d, "val").groupBy("split").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"), F.max("sample_id").alias("last"))


@query("teacher_rows")
def _(spark, d):
    """Fixed rows of a mock teacher for every training text, as moments."""
    got = encoders.encode(table(spark, d, "train"), encoders.mock_rows)
    each = got.select(F.explode("rows").alias("v"))
    return stats.merged_moments(stats.partial_moments(each, [], "v"))


@query("student_rows")
def _(spark, d):
    """A row a word of a mock student, the lengths and the last row's norm."""
    got = encoders.encode(table(spark, d, "val"), encoders.mock_tokens)
    return got.select("sample_id", "len", F.round(vectors.norm(F.element_at("rows", -1)), 4).alias("last_norm"))


@query("distilled_map")
def _(spark, d):
    """A ridge map from each mock student row to all four mock teacher rows, fitted on train and judged on val."""
    out = Written(spark, "distil")

    def both(name):
        t = table(spark, d, name)
        y = encoders.encode(t, encoders.mock_rows).select("sample_id", F.col("rows").alias("t"))
        x = encoders.encode(t, encoders.mock_tokens).select("sample_id", F.col("rows").alias("x"))
        return out.table(stats.paired_rows(x.join(y, "sample_id"), "x", "t", 4), name)

    w = stats.ridge(both("train"), "x", "t")
    val = stats.split_rows(both("val").withColumn("y", vectors.linear(F.col("x"), w.T.tolist())), ["y", "t"], 4)
    return val.agg(F.avg(vectors.cosine(F.col("y"), F.col("t"))).alias("cos"), (F.sum(vectors.squared_distance(F.col("y"), F.col("t"))) / F.sum(vectors.dot(F.col("t"), F.col("t")))).alias("rel"))


def _sharded(rows, key):
    r = ranked(rows.withColumn("_n", F.length("text")), ["_n", key], "place").drop("_n")
    return r.withColumn("shard", chunk(F.col("place"), 256))


@query("seeded_shards")
def _(spark, d):
    """Validation texts in the seeded layout, packed and unpacked: for each shard its samples, ids and target rows, and the sum of the ids."""
    rows = Written(spark, "seeded").table(encoders.encode_seeded(_sharded(table(spark, d, "val").select("sample_id", "text"), "sample_id").select("place", "text"), key="place"), "rows")
    packed = layouts.pack(rows.withColumn("shard", chunk(F.col("place"), 256)), layouts.SEEDED)
    back = layouts.unpack(packed, layouts.SEEDED)
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return back.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.sum(F.size("t")).alias("rows"), F.sum(total).alias("id_sum"))


@query("aligned_shards")
def _(spark, d):
    """Training samples with their images in the aligned layout with sparse targets: for each shard its samples, positions, target rows that stay, and image rows."""
    rows = table(spark, d, "train").select("sample_id", "text", F.coalesce(F.expr("cardinality(images)"), F.lit(0)).alias("n_images"))
    got = Written(spark, "aligned").table(encoders.encode_aligned(_sharded(rows, "sample_id").select("place", "text", "n_images"), key="place"), "rows")
    sparse = got.withColumn("t", layouts.without_segments(F.col("t"), F.col("starts"), F.col("lens"))).withColumn("shard", chunk(F.col("place"), 256))
    back = layouts.unpack(layouts.pack(sparse, layouts.ALIGNED), layouts.ALIGNED)
    return back.groupBy("shard").agg(F.count("*").alias("n"), *(F.sum(F.size(c)).alias(a) for c, a in (("ids", "positions"), ("t", "kept"), ("v", "image_rows"), ("starts", "segments"))))
