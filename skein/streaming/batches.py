"""Replayable batch order, resume positions, and shards taken in as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import draws
from skein.operators.ranking import ranked


def epoch_order(rows: DataFrame, epochs: int, batch: int, seed: int | str, shard: tuple[str, ...] = ("split", "shard"), row: str = "pos") -> DataFrame:
    """(epoch, shard_i, batch_i, place) of each row in each epoch: shards permuted by (seed, epoch), rows within a shard by
    (seed, epoch, shard); the last short batch of a shard is kept. Shards are bounded, and so are their windows; the number of a
    shard is its rank among all shards of the epoch, over range partitions.
    """
    epoch = rows.sparkSession.range(epochs).select(F.col("id").cast("int").alias("epoch"))
    shards = rows.select(*shard).distinct().crossJoin(F.broadcast(epoch))  # epochs are a handful
    order = draws.order_key(seed, F.col("epoch"), *map(F.col, shard))
    placed = ranked(shards.withColumn("_o", order), ["epoch", "_o", *shard], "_rn")
    first = placed.groupBy("epoch").agg(F.min("_rn").alias("_first"))
    shards = placed.join(F.broadcast(first), "epoch").withColumn("shard_i", (F.col("_rn") - F.col("_first")).cast("int")).drop("_o", "_rn", "_first")
    each = rows.join(shards, list(shard))
    key = draws.order_key(seed, F.col("epoch"), *map(F.col, shard), F.col(row))
    place = F.row_number().over(Window.partitionBy("epoch", *shard).orderBy(key, row)) - 1
    return each.withColumn("place", place).withColumn("batch_i", F.floor(F.col("place") / batch).cast("int"))


def after(epoch: int, shard_i: int, batch_i: int) -> Column:
    """The rows of the order from a saved position on."""
    e, s, b = F.col("epoch"), F.col("shard_i"), F.col("batch_i")
    return (e > epoch) | ((e == epoch) & ((s > shard_i) | ((s == shard_i) & (b >= batch_i))))


def take_in(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], files_per_batch: int = 4) -> None:
    """All files that arrived since the last call, in micro-batches. A batch that runs again replaces its own folder; within it
    rows are clustered by ``keys``, so there is a folder a batch, not one a shard."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.repartition(*keys).sortWithinPartitions(*keys).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(target)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
