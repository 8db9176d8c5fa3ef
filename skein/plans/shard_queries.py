"""Queries on shards: plans, offsets, batches, segments, masks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import draws, text, vectors
from skein.functions.text import BLANKS
from skein.operators import shards
from skein.operators.ranking import ranked, running
from skein.plans.registry import query, table
from skein.sources import readers

ROWS = """WITH rows AS (SELECT split, shard, generate_subscripts(prompts, 1) - 1 AS pos, coalesce(unnest(prompts), '') AS text, unnest(len) AS len, coalesce(unnest(n_images), 0) AS n_images FROM shards)
"""
SIZE, BUDGET, MOST, VISION = 256, 2_000, 16, 6


def rows(spark, d):
    return readers.shard_rows(table(spark, d, "shards"))


@query("shard_rows", ROWS + "SELECT split, shard, pos::INT AS pos, text, len, n_images FROM rows")
def _(spark, d):
    return rows(spark, d)


@query("shard_plan", f"WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY length(coalesce(text, '')), sample_id) AS rn FROM train) SELECT ((rn - 1) // {SIZE})::INT AS shard, count(*) AS n, min(rn) AS first_rn, max(rn) AS last_rn FROM r GROUP BY 1")
def _(spark, d):
    r = ranked(table(spark, d, "train").select("sample_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars")), ["n_chars", "sample_id"])
    return r.groupBy(shards.chunk(F.col("rn"), SIZE).alias("shard")).agg(F.count("*").alias("n"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"))


@query("shard_count", f"SELECT 'train' AS split, greatest(1, ceil(count(*) / {SIZE}.0))::BIGINT AS n FROM train UNION ALL SELECT split, greatest(1, ceil(count(*) / {SIZE}.0))::BIGINT FROM val GROUP BY split")
def _(spark, d):
    n = F.greatest(F.lit(1), F.ceil(F.count("*") / SIZE)).cast("bigint").alias("n")
    return table(spark, d, "train").select(F.lit("train").alias("split")).groupBy("split").agg(n).unionByName(table(spark, d, "val").groupBy("split").agg(n))


@query("shard_offsets", ROWS + "SELECT split, shard, pos::INT AS pos, row_number() OVER w - 1 AS place, coalesce(sum(len) OVER (PARTITION BY split, shard ORDER BY len, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM rows WINDOW w AS (PARTITION BY split, shard ORDER BY len, pos)")
def _(spark, d):
    r = shards.length_sorted(rows(spark, d).withColumnRenamed("pos", "at"), ["split", "shard"], "len", "at")
    return r.select("split", "shard", F.col("at").alias("pos"), F.col("pos").cast("bigint").alias("place"), "off")


@query("global_offsets", "SELECT sample_id, coalesce(sum(length(coalesce(text, ''))) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM train")
def _(spark, d):
    n = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
    return running(table(spark, d, "train").select("sample_id", n.alias("n")), ["sample_id"], F.col("n"), "off").select("sample_id", "off")




@query(
    "token_batches",
    ROWS.replace("WITH rows", "WITH RECURSIVE rows")
    + f""", s AS (SELECT split, shard, len, row_number() OVER (PARTITION BY split, shard ORDER BY len, pos) AS k FROM rows),
g AS (SELECT split, shard, k, 0 AS batch, 1 AS n FROM s WHERE k = 1 UNION ALL
SELECT s.split, s.shard, s.k, CASE WHEN g.n < {MOST} AND (g.n + 1) * s.len <= {BUDGET} THEN g.batch ELSE g.batch + 1 END, CASE WHEN g.n < {MOST} AND (g.n + 1) * s.len <= {BUDGET} THEN g.n + 1 ELSE 1 END FROM g JOIN s ON s.split = g.split AND s.shard = g.shard AND s.k = g.k + 1)
SELECT split, shard, batch, count(*)::INT AS n FROM g GROUP BY ALL""",
)
def _(spark, d):
    g = rows(spark, d).groupBy("split", "shard").agg(F.array_sort(F.collect_list(F.struct("len", "pos"))).alias("s"))
    sizes = shards.token_batches(F.col("s.len"), BUDGET, MOST)
    return g.select("split", "shard", F.posexplode(sizes).alias("batch", "n"))


@query(
    "vision_batches",
    ROWS.replace("WITH rows", "WITH RECURSIVE rows")
    + f""", s AS (SELECT split, shard, n_images * 2 + 1 AS cost, row_number() OVER (PARTITION BY split, shard ORDER BY pos) AS k FROM rows),
g AS (SELECT split, shard, k, 0 AS batch, cost AS total FROM s WHERE k = 1 UNION ALL
SELECT s.split, s.shard, s.k, CASE WHEN g.total + s.cost <= {VISION} THEN g.batch ELSE g.batch + 1 END, CASE WHEN g.total + s.cost <= {VISION} THEN g.total + s.cost ELSE s.cost END FROM g JOIN s ON s.split = g.split AND s.shard = g.shard AND s.k = g.k + 1)
SELECT split, shard, batch, count(*)::INT AS n FROM g GROUP BY ALL""",
)
def _(spark, d):
    g = rows(spark, d).groupBy("split", "shard").agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("n_images") * 2 + 1).alias("cost")))).alias("s"))
    return g.select("split", "shard", F.posexplode(shards.additive_batches(F.col("s.cost"), VISION)).alias("batch", "n"))


_RUNS = ROWS + ", f AS (SELECT split, shard, pos, pos - row_number() OVER (PARTITION BY split, shard ORDER BY pos) AS g FROM rows WHERE n_images > 0), segments AS (SELECT split, shard, min(pos)::INT AS start, count(*)::INT AS len FROM f GROUP BY split, shard, g)\n"


def segments(spark, d):
    return shards.runs(rows(spark, d), ["split", "shard"], "pos", F.col("n_images") > 0)


@query("segment_runs", _RUNS + "SELECT split, shard, start, len FROM segments")
def _(spark, d):
    return segments(spark, d)


@query("segment_positions", _RUNS + "SELECT r.split, r.shard, r.pos::INT AS pos, (r.pos - s.start)::INT AS within FROM rows r JOIN segments s ON r.split = s.split AND r.shard = s.shard AND r.pos >= s.start AND r.pos < s.start + s.len")
def _(spark, d):
    at = shards.segment_positions(segments(spark, d)).select("split", "shard", "pos", (F.col("pos") - F.col("start")).alias("within"))
    return rows(spark, d).select("split", "shard", "pos").join(at, ["split", "shard", "pos"])


@query("segments_of_shards", _RUNS + "SELECT split, shard, count(*) AS n, sum(len)::BIGINT AS total, max(len) AS longest, array_to_string(list(start || '+' || len ORDER BY start), ' ') AS listed FROM segments GROUP BY split, shard")
def _(spark, d):
    s = F.array_sort(F.collect_list(F.struct("start", "len")))
    return segments(spark, d).groupBy("split", "shard").agg(
        F.count("*").alias("n"), F.sum("len").cast("bigint").alias("total"), F.max("len").alias("longest"), F.array_join(F.transform(s, lambda x: F.concat_ws("+", x.start, x.len)), " ").alias("listed")
    )


@query("supervised_rows", _RUNS + "SELECT r.split, r.shard, count(*) AS n, sum(r.len)::BIGINT AS total FROM rows r WHERE r.pos >= 4 AND NOT EXISTS (SELECT 1 FROM segments s WHERE r.split = s.split AND r.shard = s.shard AND r.pos >= s.start AND r.pos < s.start + s.len) GROUP BY ALL")
def _(spark, d):
    inside = shards.segment_positions(segments(spark, d)).select("split", "shard", "pos")
    kept = rows(spark, d).where("pos >= 4").join(inside, ["split", "shard", "pos"], "left_anti")
    return kept.groupBy("split", "shard").agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("total"))


@query("spliced_rows", _RUNS + "SELECT r.split, r.shard, r.pos::INT AS pos, coalesce(-(r.pos - s.start + 1)::INT, r.len) AS value FROM rows r LEFT JOIN segments s ON r.split = s.split AND r.shard = s.shard AND r.pos >= s.start AND r.pos < s.start + s.len")
def _(spark, d):
    at = shards.segment_positions(segments(spark, d)).select("split", "shard", "pos", (-(F.col("pos") - F.col("start") + 1)).alias("v"))
    return rows(spark, d).join(at, ["split", "shard", "pos"], "left").select("split", "shard", "pos", F.coalesce("v", "len").alias("value"))


@query("padding_masks", ROWS + "SELECT split, shard, pos::INT AS pos, list_sum(list_transform(range(0, 40), lambda p: CASE WHEN p < len // 8 THEN 1 ELSE 0 END))::INT AS real, len // 8 >= 40 AS cut FROM rows")
def _(spark, d):
    m = vectors.mask(F.floor(F.col("len") / 8), F.lit(40))
    return rows(spark, d).select("split", "shard", "pos", F.size(F.filter(m, lambda x: x)).alias("real"), (F.floor(F.col("len") / 8) >= 40).alias("cut"))


@query("causal_pairs", ROWS + "SELECT split, shard, pos::INT AS pos, list_sum(range(1, len // 8 + 1))::BIGINT AS visible FROM rows WHERE len >= 8")
def _(spark, d):
    """How many (row, column) pairs a causal mask over the real positions lets through."""
    n = F.floor(F.col("len") / 8).cast("int")
    seen = F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("bigint"), lambda a, i: a + shards.visible_to(i - 1, n, n))
    return rows(spark, d).where("len >= 8").select("split", "shard", "pos", seen.alias("visible"))


@query("query_block_pairs", ROWS + "SELECT split, shard, pos::INT AS pos, (list_sum(range(1, len // 8 + 1)) + 4 * (len // 8) + 10)::BIGINT AS visible FROM rows WHERE len >= 8")
def _(spark, d):
    """As causal_pairs, with four query positions behind the text that see all of it and each other causally; the text does not see them."""
    n = F.floor(F.col("len") / 8).cast("int")
    seen = F.aggregate(F.sequence(F.lit(1), n + 4), F.lit(0).cast("bigint"), lambda a, i: a + shards.visible_to(i - 1, n, n + 4))
    return rows(spark, d).where("len >= 8").select("split", "shard", "pos", seen.alias("visible"))


@query("sparse_targets", _RUNS + "SELECT r.split, r.shard, count(*) FILTER (WHERE s.start IS NULL) AS n, coalesce(sum(r.len) FILTER (WHERE s.start IS NULL), 0)::BIGINT AS total, count(s.start) AS dropped FROM rows r LEFT JOIN segments s ON r.split = s.split AND r.shard = s.shard AND r.pos >= s.start AND r.pos < s.start + s.len GROUP BY ALL")
def _(spark, d):
    """Target rows that stay when those under image segments are dropped, with the lengths to pack."""
    inside = shards.segment_positions(segments(spark, d)).select("split", "shard", "pos", F.lit(True).alias("under"))
    r = rows(spark, d).join(inside, ["split", "shard", "pos"], "left").withColumn("kept", F.col("under").isNull())
    return r.groupBy("split", "shard").agg(F.count_if("kept").alias("n"), F.sum(F.when(F.col("kept"), F.col("len")).otherwise(0)).cast("bigint").alias("total"), F.count("under").alias("dropped"))


@query("masked_positions", ROWS + "SELECT split, shard, pos::INT AS pos, greatest(0, sum(CASE WHEN n_images = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY split, shard ORDER BY pos) - 1)::BIGINT AS place, pos = max(pos) OVER (PARTITION BY split, shard) AS last FROM rows")
def _(spark, d):
    w = Window.partitionBy("split", "shard").orderBy("pos")
    n = F.sum(F.when(F.col("n_images") == 0, 1).otherwise(0)).over(w)
    return rows(spark, d).select("split", "shard", "pos", F.greatest(F.lit(0), n - 1).cast("bigint").alias("place"), F.lead("pos").over(w).isNull().alias("last"))


@query("segment_starts", "SELECT sample_id, array_to_string(list_transform(range(len(images)), lambda i: 70 + i * (7 + 5)), ' ') AS starts FROM train WHERE len(images) > 0")
def _(spark, d):
    n = F.transform(F.col("images"), lambda _: F.lit(5))
    return table(spark, d, "train").where("cardinality(images) > 0").select("sample_id", F.array_join(shards.first_starts(n), " ").alias("starts"))


_AREAS = [(65536, 0.2), (147456, 0.5), (262144, 0.3)]


@query(
    "weighted_areas",
    "WITH u AS (SELECT sample_id, coalesce(len(images), 0) AS n, (('0x' || substr(sha1('area|' || sample_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS u FROM train) SELECT sample_id, CASE WHEN n > 1 THEN CASE WHEN u < 0.2 / 0.7 THEN 65536 ELSE 147456 END WHEN u < 0.2 THEN 65536 WHEN u < 0.7 THEN 147456 ELSE 262144 END AS area FROM u",
)
def _(spark, d):
    u = draws.uniform("area", F.col("sample_id"))
    small = F.when(u < 0.2 / 0.7, _AREAS[0][0]).otherwise(_AREAS[1][0])
    one = F.when(u < 0.2, _AREAS[0][0]).when(u < 0.7, _AREAS[1][0]).otherwise(_AREAS[2][0])
    return table(spark, d, "train").select("sample_id", F.when(F.coalesce(F.expr("cardinality(images)"), F.lit(0)) > 1, small).otherwise(one).alias("area"))


@query("missing_shards", "WITH planned AS (SELECT (range)::INT AS shard FROM range(0, (SELECT greatest(1, ceil(count(*) / 200.0))::BIGINT FROM train))) SELECT 'train-' || lpad(shard::VARCHAR, 5, '0') AS name FROM planned WHERE shard NOT IN (SELECT shard FROM shards WHERE split = 'train')")
def _(spark, d):
    n = max(1, -(-table(spark, d, "train").count() // 200))
    planned = spark.range(n).select(F.col("id").cast("int").alias("shard"))
    there = table(spark, d, "shards").where("split = 'train'").select("shard").distinct()
    return planned.join(there, "shard", "left_anti").select(text.shard_name(F.lit("train"), F.col("shard")).alias("name"))


@query("padded_words", f"WITH w AS (SELECT sample_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM train) SELECT sample_id, greatest(1, least(len(w), 12))::INT AS n, array_to_string(list_transform(range(0, 12), lambda i: coalesce(length(w[i + 1]), 0)), ' ') AS lens FROM w")
def _(spark, d):
    w = F.filter(F.split(text.normalise(F.coalesce("text", F.lit(""))), " "), lambda x: x != "")
    lens = F.transform(w, F.length)
    n = F.greatest(F.lit(1), F.least(F.size(w), F.lit(12)))
    return table(spark, d, "train").select("sample_id", n.alias("n"), F.array_join(vectors.pad(lens, F.lit(12), F.lit(0)), " ").alias("lens"))


@query(
    "routed_items",
    "WITH s AS (SELECT vec_id, unnest(range(64))::INT AS item, unnest(embedding)::DOUBLE AS score FROM embeddings), g AS (SELECT vec_id, item, item // 8 AS grp, score FROM s), "
    "b AS (SELECT *, row_number() OVER (PARTITION BY vec_id, grp ORDER BY score DESC, item) AS k FROM g), t AS (SELECT vec_id, grp, sum(score) AS s FROM b WHERE k <= 2 GROUP BY ALL), "
    "top AS (SELECT vec_id, grp FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, grp) AS r FROM t) WHERE r <= 3), "
    "i AS (SELECT g.*, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS r FROM g JOIN top USING (vec_id, grp)) SELECT vec_id, item, round(score / sum(score) OVER (PARTITION BY vec_id), 6) AS weight FROM i WHERE r <= 4",
)
def _(spark, d):
    s = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("item", "score")).withColumn("score", F.col("score").cast("double")).withColumn("grp", F.floor(F.col("item") / 8).cast("int"))
    return shards.top_groups(s, "vec_id", "grp", "item", "score", 3, 4).select("vec_id", "item", F.round("weight", 6).alias("weight"))


@query("expert_loads", "WITH s AS (SELECT vec_id, unnest(range(64))::INT AS item, unnest(embedding)::DOUBLE AS score FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, item) AS k FROM s) SELECT item, count(*) AS n, round(sum(score), 4) AS load FROM t WHERE k <= 2 GROUP BY item")
def _(spark, d):
    best = F.slice(F.sort_array(F.transform(F.col("embedding"), lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("item")))), 1, 2)
    chosen = table(spark, d, "embeddings").select(F.explode(best).alias("b")).select(F.col("b.item").alias("item"), (-F.col("b.s")).alias("score"))
    return chosen.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("load"))


@query("packed_shards", ROWS + "SELECT split, shard, string_agg(text, '' ORDER BY pos) AS packed, sum(length(text))::BIGINT AS n_chars FROM rows GROUP BY split, shard")
def _(spark, d):
    g = rows(spark, d).groupBy("split", "shard").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"), F.sum(F.length("text")).alias("n_chars"))
    return g.select("split", "shard", F.array_join(F.col("s.text"), "").alias("packed"), "n_chars")


@query("shard_samples_join", ROWS + ", t AS (SELECT coalesce(text, '') AS text, count(*) AS n FROM (SELECT text FROM train UNION ALL SELECT text FROM val) GROUP BY 1) SELECT r.split, r.shard, count(*) AS n, count(t.n) AS known FROM rows r LEFT JOIN t ON r.text = t.text GROUP BY ALL")
def _(spark, d):
    t = table(spark, d, "train").select("text").unionByName(table(spark, d, "val").select("text")).select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("k", F.lit(1))
    return rows(spark, d).join(t, "text", "left").groupBy("split", "shard").agg(F.count("*").alias("n"), F.count("k").alias("known"))


@query("prompt_ids", "SELECT sample_id, array_to_string(list_concat(list_concat([101, 102], list_transform(range(coalesce(len(images), 0) * 3), lambda i: 9)), [length(coalesce(text, '')), 2]), ' ') AS ids, CASE WHEN coalesce(len(images), 0) > 0 THEN 2 ELSE -1 END AS first_image FROM train")
def _(spark, d):
    n = F.coalesce(F.expr("cardinality(images)"), F.lit(0))
    ids = F.concat(F.array(F.lit(101), F.lit(102)), F.array_repeat(F.lit(9), n * 3), F.array(F.length(F.coalesce("text", F.lit(""))), F.lit(2)))
    at = F.when(n > 0, F.array_position(F.slice(ids, 1, 3), F.lit(9)).cast("int") - 1).otherwise(-1)
    return table(spark, d, "train").select("sample_id", F.array_join(ids, " ").alias("ids"), at.alias("first_image"))


@query("rows_by_key", ROWS + ", k AS (SELECT split, shard, len(prompts) - 1 AS pos FROM shards) SELECT r.split, r.shard, r.pos::INT AS pos, r.text FROM rows r JOIN k ON r.split = k.split AND r.shard = k.shard AND r.pos = k.pos")
def _(spark, d):
    """A point read by (container, row): the last, longest row of each shard; the packed arrays are read at that place, not exploded."""
    s = table(spark, d, "shards").withColumn("pos", F.size("prompts") - 1)
    return s.where("pos >= 0").select("split", "shard", "pos", F.coalesce(F.get("prompts", F.col("pos")), F.lit("")).alias("text"))
