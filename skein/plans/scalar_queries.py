"""Queries on scalar functions: sizes, positions, formats, templates, names."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import geometry as g
from skein.functions import text, vectors
from skein.functions.text import BLANKS
from skein.plans.registry import query, table
from skein.sources.sinks import tensor_dtype

WH = "WITH s AS (SELECT p_partkey, (p_size * 37 + 20)::INT AS w, (p_partkey % 700 + 30)::INT AS h FROM part)\n"


def sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 20).cast("int").alias("w"), (F.col("p_partkey") % 700 + 30).cast("int").alias("h"))


def _m(x: str, f: int) -> str:
    return f"greatest(round_even({x} / {f}, 0)::INT * {f}, {f})"


@query("edit_sizes", WH + f", c AS (SELECT *, least(1.0::FLOAT, (384::FLOAT / greatest(w, h)::FLOAT)::FLOAT) AS z FROM s) SELECT p_partkey, {_m('floor((w::FLOAT * z)::FLOAT)::DOUBLE', 32)} AS ew, {_m('floor((h::FLOAT * z)::FLOAT)::DOUBLE', 32)} AS eh FROM c")
def _(spark, d):
    w, h = g.edit_size(F.col("w"), F.col("h"))
    return sizes(spark, d).select("p_partkey", w.alias("ew"), h.alias("eh"))


@query("area_sizes", WH + f", c AS (SELECT *, sqrt(floor(147456.0::DOUBLE * w / h)) AS z FROM s) SELECT p_partkey, {_m('z', 32)} AS aw, {_m('(z * h / w)', 32)} AS ah FROM c")
def _(spark, d):
    w, h = g.area_size(F.col("w"), F.col("h"), F.lit(147456.0))
    return sizes(spark, d).select("p_partkey", w.alias("aw"), h.alias("ah"))


@query(
    "smart_sizes",
    WH + f", r AS (SELECT *, {_m('w::DOUBLE', 28)} AS rw, {_m('h::DOUBLE', 28)} AS rh, sqrt(w * h / 1003520.0::DOUBLE) AS down, sqrt(3136.0::DOUBLE / (w * h)) AS up FROM s) SELECT p_partkey, CASE WHEN rw * rh > 1003520 THEN greatest(floor(w / down / 28) * 28, 28)::INT WHEN rw * rh < 3136 THEN (ceil(w * up / 28) * 28)::INT ELSE rw END AS sw, "
    "CASE WHEN rw * rh > 1003520 THEN greatest(floor(h / down / 28) * 28, 28)::INT WHEN rw * rh < 3136 THEN (ceil(h * up / 28) * 28)::INT ELSE rh END AS sh FROM r",
)
def _(spark, d):
    w, h = g.smart_size(F.col("w"), F.col("h"))
    return sizes(spark, d).select("p_partkey", w.alias("sw"), h.alias("sh"))


def _smart(w: str, h: str, least: int, most: int, of: str) -> str:
    rw, rh, x = _m(f"{w}::DOUBLE", 28), _m(f"{h}::DOUBLE", 28), w if of == "w" else h
    return (
        f"CASE WHEN {rw} * {rh} > {most} THEN greatest(floor({x} / sqrt({w} * {h} / {most}.0::DOUBLE) / 28) * 28, 28)::INT WHEN {rw} * {rh} < {least} THEN (ceil({x} * sqrt({least}.0::DOUBLE / ({w} * {h})) / 28) * 28)::INT ELSE {_m(f'{x}::DOUBLE', 28)} END"
    )


@query("vision_sizes", WH + f", r AS (SELECT p_partkey, {_smart('w', 'h', *g.LOADER, 'w')} AS w1, {_smart('w', 'h', *g.LOADER, 'h')} AS h1 FROM s) SELECT p_partkey, {_smart('w1', 'h1', g.TOWER, g.TOWER, 'w')} AS vw, {_smart('w1', 'h1', g.TOWER, g.TOWER, 'h')} AS vh FROM r")
def _(spark, d):
    w, h = g.vision_size(F.col("w"), F.col("h"))
    return sizes(spark, d).select("p_partkey", w.alias("vw"), h.alias("vh"))


@query("image_slots", WH + "SELECT p_partkey, ((w // 32) * (h // 32))::INT AS slots FROM s")
def _(spark, d):
    return sizes(spark, d).select("p_partkey", g.slots(F.col("w"), F.col("h")).alias("slots"))


@query("nearest_places", WH + "SELECT p_partkey, array_to_string(list_transform(range(0, 16), lambda i: (i * w // 16)), ' ') AS places FROM s")
def _(spark, d):
    return sizes(spark, d).select("p_partkey", F.array_join(g.nearest(F.lit(16), F.col("w")), " ").alias("places"))


@query("learning_rates", "SELECT DISTINCT step, round(CASE WHEN step < 100 THEN 1e-3 * (step + 1) / 100 ELSE 1e-3 * (0.1 + 0.45 * (1 + cos(pi() * least((step - 100) / 19900.0::DOUBLE, 1.0)))) END, 12) AS lr FROM train_log")
def _(spark, d):
    return table(spark, d, "train_log").select("step", F.round(g.learning_rate(F.col("step"), 100, 20000, 1e-3), 12).alias("lr")).distinct()


@query(
    "image_positions",
    WH + ", c AS (SELECT p_partkey, (w // 32)::BIGINT AS gw, (h // 32)::BIGINT AS gh, (p_partkey % 5)::BIGINT AS t0 FROM s), g AS (SELECT *, unnest(range(0, gh)) AS y FROM c WHERE gw > 0 AND gh > 0), p AS (SELECT *, unnest(range(0, gw)) AS x FROM g) SELECT p_partkey, y AS row, x AS col, t0 AS t, t0 + y AS ty, t0 + x AS tx, t0 + greatest(gh, gw) AS nxt, y - (gh - 1) // 2 AS cy, x - (gw - 1) // 2 AS cx FROM p",
)
def _(spark, d):
    c = sizes(spark, d).select("p_partkey", F.floor(F.col("w") / 32).alias("gw"), F.floor(F.col("h") / 32).alias("gh"), (F.col("p_partkey") % 5).alias("t"))
    c = c.where("gw > 0 and gh > 0").withColumn("row", F.explode(F.expr("sequence(0L, gh - 1)"))).withColumn("col", F.explode(F.expr("sequence(0L, gw - 1)")))
    return c.selectExpr("p_partkey", "row", "col", "t", "t + row AS ty", "t + col AS tx", "t + greatest(gh, gw) AS nxt", "row - (gh - 1) div 2 AS cy", "col - (gw - 1) div 2 AS cx")


@query("rotary_ladder", "WITH f AS (SELECT i, pow(10000.0::DOUBLE, -i / 32.0::DOUBLE) AS f FROM range(0, 32) t(i)) SELECT i, round(f, 9) AS freq, round(cos(7 * f), 9) AS c, round(sin(7 * f), 9) AS s, f <= coalesce(lag(f) OVER (ORDER BY i), 1.0) AND f > 0 AS ok FROM f")
def _(spark, d):
    f = spark.range(32).select(F.col("id").alias("i"), F.pow(F.lit(10000.0), -F.col("id") / 32.0).alias("f"))
    before = F.coalesce(F.lag("f").over(Window.orderBy("i")), F.lit(1.0))  # 32 rows
    return f.select("i", F.round("f", 9).alias("freq"), F.round(F.cos(7 * F.col("f")), 9).alias("c"), F.round(F.sin(7 * F.col("f")), 9).alias("s"), ((F.col("f") <= before) & (F.col("f") > 0)).alias("ok"))


@query(
    "human_formats",
    "SELECT o_orderkey, CASE WHEN b >= 1099511627776 THEN round(b / 1099511627776.0::DOUBLE, 1)::VARCHAR || ' TB' WHEN b >= 1073741824 THEN round(b / 1073741824.0::DOUBLE, 1)::VARCHAR || ' GB' WHEN b >= 1048576 THEN round(b / 1048576.0::DOUBLE, 1)::VARCHAR || ' MB' WHEN b >= 1024 THEN round(b / 1024.0::DOUBLE, 1)::VARCHAR || ' KB' ELSE b || ' B' END AS size, "
    "CASE WHEN s < 0 THEN '—' WHEN s >= 3600 THEN s // 3600 || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm' WHEN s >= 60 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS took FROM (SELECT o_orderkey, floor(o_totalprice * (o_orderkey % 977))::BIGINT AS b, (o_orderkey * 13 % 200000 - 50)::BIGINT AS s FROM orders)",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * (F.col("o_orderkey") % 977)).alias("b"), (F.col("o_orderkey") * 13 % 200000 - 50).alias("s"))
    return o.select("o_orderkey", text.human_bytes(F.col("b")).alias("size"), text.human_duration(F.col("s")).alias("took"))


@query("step_counts", "WITH s AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_partkey || 'k' WHEN 1 THEN '1_' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 2 THEN '20,' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') WHEN 3 THEN 'x' || p_partkey ELSE '-' || p_partkey END AS raw FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN nullif(p_partkey * 1000, 0) WHEN 1 THEN 1000 + p_partkey % 1000 WHEN 2 THEN 20000 + p_partkey % 1000 END::BIGINT AS steps FROM s")
def _(spark, d):
    k, low = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    raw = F.when(k % 5 == 0, F.concat(k.cast("string"), F.lit("k"))).when(k % 5 == 1, F.concat(F.lit("1_"), low)).when(k % 5 == 2, F.concat(F.lit("20,"), low)).when(k % 5 == 3, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("-"), k.cast("string")))
    return table(spark, d, "part").select("p_partkey", text.parse_steps(raw).alias("steps"))


@query("templates", "SELECT sample_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '" + BLANKS + "', ' ', 'g')) = '' THEN 'Describe nothing.' || chr(10) ELSE 'Describe: ' || text || chr(10) END AS plain, CASE WHEN coalesce(len(images), 0) > 0 THEN array_to_string(list_transform(range(1, len(images) + 1), lambda i: 'Image ' || i || ': <pad><pad>' || chr(10)), '') ELSE '' END || coalesce(text, '') AS with_images FROM train")
def _(spark, d):
    n = F.coalesce(F.expr("cardinality(images)"), F.lit(0))
    return table(spark, d, "train").select("sample_id", text.template(F.col("text")).alias("plain"), text.image_template(F.col("text"), n, 2).alias("with_images"))


@query("row_costs", "SELECT split, sum(n)::BIGINT AS n, round(sum(n * bytes) / greatest(1, sum(n)), 3) AS mean_bytes, sum(n * bytes)::BIGINT AS total FROM (SELECT split, list_sum(len)::BIGINT AS n, (64 + len(prompts) % 7) * 2 AS bytes FROM shards) GROUP BY split")
def _(spark, d):
    s = table(spark, d, "shards").select("split", F.aggregate("len", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"), ((F.lit(64) + F.size("prompts") % 7) * 2).alias("bytes"))
    cost = F.sum(F.col("n") * F.col("bytes"))
    return s.groupBy("split").agg(F.sum("n").alias("n"), F.round(cost / F.greatest(F.lit(1), F.sum("n")), 3).alias("mean_bytes"), cost.alias("total"))


_PATHS = "WITH f AS (SELECT DISTINCT 'images/' || source || '/' || filename AS path FROM captions WHERE filename IS NOT NULL)\n"


def paths(spark, d):
    return table(spark, d, "captions").where("filename is not null").select(F.concat(F.lit("images/"), F.col("source"), F.lit("/"), F.col("filename")).alias("path")).distinct()


@query("path_parts", _PATHS + "SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM f")
def _(spark, d):
    p = F.col("path")
    return paths(spark, d).select("path", F.substring_index(p, "/", -1).alias("name"), text.suffix(p).alias("suffix"), text.parent(p).alias("parent"), text.stem(p).alias("stem"))


@query("glob_filter", _PATHS + "SELECT path FROM f WHERE path GLOB 'images/photo*1.jpg' OR path GLOB '*/0*.png' OR path GLOB '*folder?a*'")
def _(spark, d):
    return paths(spark, d).where(text.matches_any(F.col("path"), ["images/photo*1.jpg", "*/0*.png", "*folder?a*"]))


@query("suffix_filter", _PATHS + "SELECT lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS suffix, count(*) AS n FROM f WHERE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) IN ('.jpg', '.png', '.jpeg', '.webp', '.bmp') GROUP BY 1")
def _(spark, d):
    s = text.suffix(F.col("path"))
    return paths(spark, d).where(s.isin(".jpg", ".png", ".jpeg", ".webp", ".bmp")).groupBy(s.alias("suffix")).agg(F.count("*").alias("n"))


@query("html_escaped", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.escape_html(F.col("text")).alias("html"))


_NAMES = "WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'model.block.' || p_partkey || '.norm.weight' WHEN 1 THEN 'model.block.' || p_partkey || '.bias' WHEN 2 THEN 'vision.patch.' || p_partkey ELSE 'model.head.' || p_partkey END AS name, CASE p_partkey % 4 WHEN 1 THEN [p_size] WHEN 2 THEN [p_size, 3, 2, 14, 14] ELSE [p_size, 32 * (1 + p_partkey % 3) + CASE WHEN p_partkey % 8 = 3 THEN 1 ELSE 0 END] END AS shape FROM part)\n"


def tensors(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    name = F.when(k % 4 == 0, F.format_string("model.block.%d.norm.weight", k)).when(k % 4 == 1, F.format_string("model.block.%d.bias", k)).when(k % 4 == 2, F.format_string("vision.patch.%d", k)).otherwise(F.format_string("model.head.%d", k))
    last = 32 * (1 + k % 3) + F.when(k % 8 == 3, 1).otherwise(0)
    one = lambda *x: F.array(*(F.lit(y).cast("bigint") if isinstance(y, int) else y.cast("bigint") for y in x))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.when(k % 4 == 1, one(size)).when(k % 4 == 2, one(size, 3, 2, 14, 14)).otherwise(one(size, last)).alias("shape"))


@query("tensor_dtypes", _NAMES + "SELECT CASE WHEN len(shape) = 5 THEN 'bf16' WHEN len(shape) = 1 OR name LIKE '%norm%' THEN 'f32' WHEN shape[-1] % 32 = 0 THEN 'q8_0' ELSE 'f16' END AS dtype, count(*) AS n FROM t GROUP BY 1")
def _(spark, d):
    return tensors(spark, d).groupBy(tensor_dtype(F.col("name"), F.col("shape"), True).alias("dtype")).agg(F.count("*").alias("n"))


@query("tensor_names", _NAMES + "SELECT p_partkey, regexp_replace(name, '^model\\.', '') AS name, starts_with(name, 'vision.') AS vision, regexp_matches(name, '^(vision|visual)\\.') AS companion FROM t WHERE NOT name LIKE '%.bias'")
def _(spark, d):
    n = F.col("name")
    return tensors(spark, d).where(~n.endswith(".bias")).select("p_partkey", F.regexp_replace(n, r"^model\.", "").alias("name"), n.startswith("vision.").alias("vision"), n.rlike(r"^(vision|visual)\.").alias("companion"))


@query("shard_names", "SELECT split, shard, split || '-' || lpad(shard::VARCHAR, 5, '0') AS name FROM shards")
def _(spark, d):
    return table(spark, d, "shards").select("split", "shard", text.shard_name(F.col("split"), F.col("shard")).alias("name"))


@query("auto_budgets", "SELECT s_suppkey, greatest(1, coalesce(nullif((s_suppkey % 3) * 100, 0), floor(24 * s_nationkey / 10.0)))::BIGINT AS budget, round(greatest(s_acctbal - 1500, 500), 2) AS memory FROM supplier")
def _(spark, d):
    auto = F.floor(24 * F.col("s_nationkey") / 10.0)
    budget = F.greatest(F.lit(1), F.coalesce(F.expr("nullif((s_suppkey % 3) * 100, 0)"), auto)).cast("bigint")
    return table(spark, d, "supplier").select("s_suppkey", budget.alias("budget"), F.round(F.greatest(F.col("s_acctbal") - 1500, F.lit(500)), 2).alias("memory"))


@query("finite_values", "SELECT run_id, step, max(round(val_cos, 9)) FILTER (WHERE NOT isnan(val_cos) AND NOT isinf(val_cos)) AS cos, count(*) AS n FROM train_log GROUP BY run_id, step")
def _(spark, d):
    return table(spark, d, "train_log").groupBy("run_id", "step").agg(F.max(F.round(vectors.finite(F.col("val_cos")), 9)).alias("cos"), F.count("*").alias("n"))


@query("byte_features", "WITH h AS (SELECT sample_id, hex(encode(text)) AS h FROM train WHERE text <> ''), b AS (SELECT sample_id, h, unnest(range(1, least(512, length(h) // 2) + 1)) AS i FROM h), v AS (SELECT sample_id, i, ('0x' || substr(h, (2 * i - 1)::INT, 2))::INT AS v FROM b), f AS (SELECT sample_id, ((7 * (i - 1) + v) % 64)::INT AS bucket, (v - 96) / 32.0::DOUBLE AS x FROM v) SELECT sample_id, bucket, round(sum(x), 5) AS x FROM f GROUP BY ALL")
def _(spark, d):
    """Features of the first 512 UTF-8 bytes (the operator's own length) of every text."""
    rows = table(spark, d, "train").where("text <> ''").select("sample_id", F.hex(F.encode("text", "utf-8")).alias("h"))
    byte = F.expr("transform(sequence(1, least(512, cast(length(h) / 2 AS int))), i -> cast(conv(substr(h, 2 * i - 1, 2), 16, 10) AS int))")
    b = rows.select("sample_id", F.posexplode(byte).alias("i", "b"))
    return b.groupBy("sample_id", ((7 * F.col("i") + F.col("b")) % 64).alias("bucket")).agg(F.round(F.sum((F.col("b") - 96) / 32.0), 5).alias("x"))


@query("word_tokens")
def _(spark, d):
    """Word ids by CRC-32 of every training text (DuckDB has no CRC-32)."""
    return table(spark, d, "train").select("sample_id", text.word_ids(F.col("text")).alias("ids"))


@query("normalised_words", f"SELECT length(w) AS n_chars, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(text, '{BLANKS}', ' ', 'g')), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY 1")
def _(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split(text.normalise(F.col("text")), " ")).alias("w")).where("w <> ''")
    return w.groupBy(F.length("w").cast("bigint").alias("n_chars")).agg(F.count("*").alias("n"))


@query("axis_rotary", WH + ", c AS (SELECT p_partkey, unnest(range(0, 32)) AS i, (p_partkey % 5)::BIGINT AS t, (w // 32)::BIGINT AS x, (h // 32)::BIGINT AS y FROM s), a AS (SELECT *, CASE WHEN i % 3 = 1 AND i < 24 THEN y WHEN i % 3 = 2 AND i < 24 THEN x ELSE t END AS p, pow(10000.0::DOUBLE, -i / 32.0::DOUBLE) AS f FROM c) SELECT p_partkey, round(sum(cos(p * f)), 7) AS c, round(sum(sin(p * f)), 7) AS s, sum(p)::BIGINT AS total FROM a GROUP BY p_partkey")
def _(spark, d):
    """Rotary angles of three axes, interleaved: of each three frequencies one of time, height and width, and time alone behind the 24th."""
    at = sizes(spark, d).select("p_partkey", F.array(F.col("p_partkey") % 5, F.floor(F.col("h") / 32), F.floor(F.col("w") / 32)).alias("at"))
    angles = g.axis_angles(F.col("at"), 32, 8)
    total = lambda f: F.aggregate(F.transform("angles", lambda x: f(x["angle"])), F.lit(0.0), lambda a, x: a + x)
    a = at.withColumn("angles", angles)
    return a.select("p_partkey", F.round(total(F.cos), 7).alias("c"), F.round(total(F.sin), 7).alias("s"), F.aggregate(F.transform("angles", lambda x: x["place"]), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))
