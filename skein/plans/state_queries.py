"""Queries on state: manifests, status, logs, settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import state
from skein.operators.ranking import ranked
from skein.plans.registry import query, table
from skein.sources import readers, sinks
from skein.session import Written

# Orders stand for expected files (of the customer's material), line items for those present.
FILES = """WITH expected AS (SELECT 'm' || o_custkey % 40 AS material, 'd' || o_orderkey % 9 || '/f' || o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT END AS size FROM orders),
there AS (SELECT 'd' || l_orderkey % 9 || '/f' || l_orderkey AS path, max(floor(o_totalprice)::BIGINT + CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE 0 END) AS found FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey),
files AS (SELECT e.*, found, coalesce(size = 0 OR found = size, false) AND found IS NOT NULL AS ok FROM expected e LEFT JOIN there USING (path))
"""


def path(key: str):
    return F.concat(F.lit("d"), (F.col(key) % 9).cast("string"), F.lit("/f"), F.col(key).cast("string"))


def files(spark, d):
    o = table(spark, d, "orders")
    size = F.floor("o_totalprice")
    expected = o.select(F.concat(F.lit("m"), (F.col("o_custkey") % 40).cast("string")).alias("material"), path("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 7 == 0, 0).otherwise(size).alias("size"))
    # A file is there if its order has line items, and too long by one if one of them has number 3, 7 ...
    late = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((F.col("l_linenumber") % 4 == 3).cast("int")).alias("late"))
    item = late.join(o.select(F.col("o_orderkey").alias("l_orderkey"), size.alias("s")), "l_orderkey")
    there = item.select(path("l_orderkey").alias("path"), (F.col("s") + F.col("late")).alias("size"))
    return state.present(expected, there)


@query("present_files", FILES + "SELECT material, path, size, found, ok FROM files")
def _(spark, d):
    return files(spark, d).select("material", "path", "size", "found", "ok")


@query("material_status", FILES + "SELECT material, count(*) AS n, count(*) FILTER (WHERE ok) AS n_present, sum(size)::BIGINT AS total, least(coalesce(sum(size) FILTER (WHERE ok), 0), sum(size))::BIGINT AS done, array_to_string(list_sort(list(path) FILTER (WHERE NOT ok))[1:8], ' ') AS missing, bool_and(ok) AS complete FROM files GROUP BY material")
def _(spark, d):
    c = state.completeness(files(spark, d))
    return c.select("material", "n", "n_present", "total", "done", F.array_join("missing", " ").alias("missing"), "complete")


@query("progress_fractions", FILES + "SELECT material, round(least(1.0, coalesce(sum(size) FILTER (WHERE ok), 0) / greatest(1, sum(size))), 6) AS fraction, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS percent FROM files GROUP BY material")
def _(spark, d):
    c = state.completeness(files(spark, d))
    return c.select("material", F.round(F.least(F.lit(1.0), F.col("done") / F.greatest(F.lit(1), F.col("total"))), 6).alias("fraction"), F.round(100.0 * F.col("n_present") / F.col("n"), 1).alias("percent"))


@query("readiness", FILES + ", m AS (SELECT material, bool_and(ok) AS complete, count(*) AS n FROM files GROUP BY material) SELECT coalesce(bool_and(complete) FILTER (WHERE n > 350 OR material = 'm1'), true) AS ready, array_to_string(list_sort(list(material) FILTER (WHERE NOT complete)), ' ') AS waiting FROM m")
def _(spark, d):
    c = state.completeness(files(spark, d))
    wanted = (F.col("n") > 350) | (F.col("material") == "m1")
    return c.agg(F.coalesce(F.bool_and(F.when(wanted, F.col("complete"))), F.lit(True)).alias("ready"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("complete"), F.col("material")))), " ").alias("waiting"))


@query("found_elsewhere", FILES + "SELECT material, min(substr(path, 1, 2)) AS root FROM files WHERE ok AND material IN (SELECT material FROM files WHERE NOT ok) GROUP BY material")
def _(spark, d):
    f = Written(spark, "files").table(files(spark, d), "files")
    return f.where("ok").join(f.where("not ok").select("material").distinct(), "material", "left_semi").groupBy("material").agg(F.min(F.substring("path", 1, 2)).alias("root"))


@query("folder_sizes", FILES + "SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(DISTINCT path) AS files, sum(found)::BIGINT AS bytes FROM files WHERE found IS NOT NULL GROUP BY 1")
def _(spark, d):
    return files(spark, d).where("found is not null").groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.countDistinct("path").alias("files"), F.sum("found").alias("bytes"))


@query("files_listed", FILES + "SELECT path, size, row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/', 1) ORDER BY lower(path)) AS place FROM files")
def _(spark, d):
    """Each file with its place in its folder; a folder may hold a third of all files, so the places are ranks over ranges."""
    f = files(spark, d).select("path", "size", F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.lower("path").alias("low"))
    r = Written(spark, "files").table(ranked(f, ["folder", "low"], "rn"), "ranked")
    first = r.groupBy("folder").agg(F.min("rn").alias("first"))
    return r.join(first, "folder").select("path", "size", (F.col("rn") - F.col("first") + 1).alias("place"))


@query("stage_states", "WITH s AS (SELECT event_type AS stage, count(*) AS n, max(value) AS v FROM events GROUP BY event_type), a AS (SELECT event_type AS stage, bool_or(value > 190) AS there FROM events GROUP BY event_type) SELECT stage, CASE WHEN there THEN 'done' WHEN n > 2000 THEN 'running' ELSE 'waiting' END AS state FROM s LEFT JOIN a USING (stage)")
def _(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("v"))
    a = e.groupBy("event_type").agg(F.bool_or(F.col("value") > 190).alias("there"))
    return s.join(a, "event_type", "left").select(F.col("event_type").alias("stage"), F.when(F.col("there"), "done").when(F.col("n") > 2000, "running").otherwise("waiting").alias("state"))


_USER = "WITH u AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, max(ts) AS t FROM events GROUP BY user_id), w AS (SELECT *, CASE last WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' END AS state, user_id % 2 = 0 AS alive FROM u)\n"


@query("run_status", _USER + "SELECT user_id, CASE WHEN state IN ('done', 'failed', 'stopped') THEN state WHEN state = 'running' AND NOT alive THEN 'interrupted' ELSE coalesce(state, 'idle') END AS status FROM w")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    st = F.when(F.col("last") == "purchase", "done").when(F.col("last") == "error", "failed").when(F.col("last") == "view", "running")
    return u.select("user_id", state.status(st, F.col("user_id") % 2 == 0).alias("status"))


@query("gates", _USER + "SELECT user_id, CASE WHEN state = 'running' AND alive THEN 'a job is running' WHEN state IS NULL THEN 'there is no checkpoint' END AS reason, state = 'done' OR user_id % 5 = 0 AS wanted FROM w")
def _(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    st = F.when(F.col("last") == "purchase", "done").when(F.col("last") == "error", "failed").when(F.col("last") == "view", "running")
    reason = F.when((st == "running") & (F.col("user_id") % 2 == 0), "a job is running").when(st.isNull(), "there is no checkpoint")
    return u.select("user_id", reason.alias("reason"), ((st == "done") | (F.col("user_id") % 5 == 0)).alias("wanted"))


# One row a run and step: the repeated rows of the log are equal.
LOG = "WITH log AS (SELECT run_id, step, min(loss) AS loss, min(val_cos) AS val_cos, min(prompts_per_s) AS rate, min(time) AS time FROM train_log GROUP BY run_id, step)\n"


def log(spark, d):
    t = table(spark, d, "train_log")
    return t.groupBy("run_id", "step").agg(F.min("loss").alias("loss"), F.min("val_cos").alias("val_cos"), F.min("prompts_per_s").alias("rate"), F.min("time").alias("time"))


def run_window():
    return Window.partitionBy("run_id").orderBy("step")


@query("log_scan", "SELECT step, round(loss, 9) AS loss, round(lr, 9) AS lr, count(*) AS n FROM train_log WHERE step IS NOT NULL AND loss IS NOT NULL AND lr IS NOT NULL AND NOT isnan(loss) AND NOT isnan(lr) GROUP BY ALL")
def _(spark, d):
    path_ = sinks.write_csv(table(spark, d, "train_log").select("step", "loss", "lr"), "log")
    return readers.metrics(spark, path_, ["loss", "lr"]).select("step", F.round("loss", 9).alias("loss"), F.round("lr", 9).alias("lr")).groupBy("step", "loss", "lr").agg(F.count("*").alias("n"))


@query("log_thinned", LOG + ", r AS (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn, count(*) OVER (PARTITION BY run_id) AS n FROM log), k AS (SELECT *, greatest(1.0::DOUBLE, n / 40.0::DOUBLE) AS s FROM r) SELECT run_id, step FROM k WHERE floor(ceil((rn - 1) / s) * s) = rn - 1 OR rn = n")
def _(spark, d):
    r = log(spark, d).select("run_id", "step").withColumn("rn", F.row_number().over(run_window())).withColumn("n", F.count("*").over(Window.partitionBy("run_id")))
    return state.thinned(r, "rn", "n", 40).select("run_id", "step")


@query("rolling_rates", LOG + "SELECT run_id, step, round(avg(rate) OVER w, 6) AS rate, round((max(step) OVER (PARTITION BY run_id) - step) / avg(rate) OVER w, 4) AS eta, round(time - lag(time) OVER (PARTITION BY run_id ORDER BY step), 4) AS took FROM log WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    rate = F.avg("rate").over(run_window().rowsBetween(-4, 0))
    left = F.max("step").over(Window.partitionBy("run_id")) - F.col("step")
    return log(spark, d).select("run_id", "step", F.round(rate, 6).alias("rate"), F.round(left / rate, 4).alias("eta"), F.round(F.col("time") - F.lag("time").over(run_window()), 4).alias("took"))


@query("best_so_far", LOG + ", v AS (SELECT run_id, step, val_cos, max(val_cos) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log WHERE NOT isnan(val_cos)) SELECT run_id, step, round(greatest(before, val_cos), 6) AS best, before IS NULL OR val_cos > before AS improved FROM v")
def _(spark, d):
    best, improved = state.running_best(F.col("val_cos"), run_window())
    return log(spark, d).where("NOT isnan(val_cos)").select("run_id", "step", F.round(best, 6).alias("best"), improved.alias("improved"))


@query("carried_forward", LOG + "SELECT run_id, step, round(last_value(CASE WHEN isnan(val_cos) THEN NULL ELSE val_cos END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS val_cos FROM log")
def _(spark, d):
    return log(spark, d).select("run_id", "step", F.round(state.carried("val_cos", run_window()), 6).alias("val_cos"))


@query("chart_scale", LOG + ", b AS (SELECT min(loss) AS lo, max(loss) AS hi FROM log WHERE val_cos > -1 OR isnan(val_cos)) SELECT run_id, step, round((loss - lo) / greatest(hi - lo, 1e-9) * 200, 4) AS y FROM log, b WHERE loss IS NOT NULL")
def _(spark, d):
    g = log(spark, d)
    b = g.where("val_cos > -1").agg(F.min("loss").alias("lo"), F.max("loss").alias("hi"))
    return g.where("loss is not null").crossJoin(F.broadcast(b)).select("run_id", "step", F.round((F.col("loss") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * 200, 4).alias("y"))


@query("log_tail", "SELECT event_id, event_type, value FROM events WHERE event_id > (SELECT max(event_id) - 1000 FROM events) ORDER BY event_id LIMIT 500")
def _(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("event_id")).first()[0] or 0
    return e.where(F.col("event_id") > last - 1000).orderBy("event_id").limit(500).select("event_id", "event_type", "value")


@query("elapsed", "SELECT run_id, round(max(time) - min(time), 3) AS seconds, max(step) AS steps, CASE WHEN max(time) - min(time) > 2 THEN round((max(step) - min(step)) / (max(time) - min(time)), 6) END AS rate FROM train_log GROUP BY run_id")
def _(spark, d):
    took = F.max("time") - F.min("time")
    return table(spark, d, "train_log").groupBy("run_id").agg(F.round(took, 3).alias("seconds"), F.max("step").alias("steps"), F.when(took > 2, F.round((F.max("step") - F.min("step")) / took, 6)).alias("rate"))


@query("manifest_upsert", "WITH old AS (SELECT p_partkey AS k, nullif(p_size, 1)::BIGINT AS step FROM part), new AS (SELECT l_suppkey AS k, max(l_orderkey)::BIGINT AS step FROM lineitem GROUP BY l_suppkey) SELECT k, step, row_number() OVER (ORDER BY coalesce(step, 0), k) AS place FROM (SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new)")
def _(spark, d):
    """The parts as a manifest, the suppliers of all line items as its new entries."""
    old = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.nullif(F.col("p_size").cast("bigint"), F.lit(1)).alias("step"))
    new = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.max("l_orderkey").cast("bigint").alias("step"))
    return ranked(state.upsert(old, new, "k").withColumn("s", F.coalesce("step", F.lit(0))), ["s", "k"], "place").drop("s")


@query("registry_overrides", "SELECT n_nationkey, coalesce(s.name, c.name, n_name) AS name FROM nation LEFT JOIN (SELECT s_nationkey, min(s_name) AS name FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, min(c_name) AS name FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c ON c_nationkey = n_nationkey")
def _(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 9000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("a"))
    c = table(spark, d, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_name").alias("b"))
    return table(spark, d, "nation").join(s, "n_nationkey", "left").join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce("a", "b", "n_name").alias("name"))


@query("settings_merged", "WITH a AS (SELECT c_mktsegment || '.' || c_nationkey AS k, max(c_acctbal) AS v FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_mktsegment || '.' || c_nationkey AS k, max(c_acctbal) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) SELECT k, coalesce(b.v, a.v) AS v FROM a FULL JOIN b USING (k)")
def _(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.concat_ws(".", "c_mktsegment", "c_nationkey"))
    a = c.where("c_custkey % 2 = 0").groupBy("k").agg(F.max("c_acctbal").alias("x"))
    b = c.where("c_custkey % 3 = 0").groupBy("k").agg(F.max("c_acctbal").alias("y"))
    return a.join(b, "k", "full").select("k", F.coalesce("y", "x").alias("v"))


@query("json_fields", "SELECT event_id, coalesce((props ->> '$.k')::INT, -1) AS k, coalesce(props ->> '$.missing.deep', 'none') AS deep FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing.deep"), F.lit("none")).alias("deep"))


@query("json_entries", "SELECT e.key, count(*) AS n, max(CASE WHEN regexp_full_match(e.v, '-?[0-9.]+') THEN 'number' ELSE 'text' END) AS kind FROM (SELECT unnest(json_keys(props)) AS key, props FROM events) t, LATERAL (SELECT t.key AS key, t.props ->> ('$.' || t.key) AS v) e GROUP BY e.key")
def _(spark, d):
    m = table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return m.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("v").rlike(r"^-?[0-9.]+$"), "number").otherwise("text")).alias("kind"))


@query("numeric_entries", "SELECT run_id, step, '{' || array_to_string(list_filter([CASE WHEN isnan(loss) THEN NULL ELSE 'loss' END, CASE WHEN isnan(val_cos) THEN NULL ELSE 'val_cos' END], lambda x: x IS NOT NULL), ',') || '}' AS keys FROM (SELECT run_id, step, min(loss) AS loss, min(val_cos) AS val_cos FROM train_log GROUP BY ALL)")
def _(spark, d):
    m = F.create_map(F.lit("loss"), F.col("loss"), F.lit("val_cos"), F.col("val_cos"), F.lit("time"), F.col("time"))
    kept = F.map_filter(F.transform_values(m, lambda _, v: vectors.finite(v)), lambda k, v: v.isNotNull() & (k != "time"))
    return log(spark, d).select("run_id", "step", F.concat(F.lit("{"), F.array_join(F.map_keys(kept), ","), F.lit("}")).alias("keys"))


@query("meta_records", "SELECT split, shard, coalesce(json_valid(meta), false) AS valid, stat_n, split || '/' || shard || '/' || stat_n AS record FROM shards")
def _(spark, d):
    record = F.to_json(F.struct("split", "shard", "stat_n"))
    back = F.from_json(record, "split string, shard int, stat_n bigint")
    return table(spark, d, "shards").select("split", "shard", F.coalesce(F.get_json_object("meta", "$").isNotNull(), F.lit(False)).alias("valid"), "stat_n", F.concat_ws("/", back.split, back.shard, back.stat_n).alias("record"))


@query("key_differences", "SELECT 'missing' AS kind, k FROM (SELECT DISTINCT c_nationkey::BIGINT AS k FROM customer EXCEPT SELECT DISTINCT s_nationkey::BIGINT FROM supplier) UNION ALL SELECT 'unexpected', k FROM (SELECT DISTINCT s_nationkey::BIGINT AS k FROM supplier EXCEPT SELECT DISTINCT c_nationkey::BIGINT FROM customer WHERE c_acctbal > 9000)")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k"), "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("k"))
    missing = c.select("k").subtract(s).select(F.lit("missing").alias("kind"), "k")
    return missing.unionByName(s.subtract(c.where("c_acctbal > 9000").select("k")).select(F.lit("unexpected").alias("kind"), "k"))


@query("required_subsets", "WITH g AS (SELECT source, list_sort(list(DISTINCT lang) FILTER (WHERE lang IS NOT NULL)) AS langs FROM documents GROUP BY source) SELECT source, list_contains(langs, 'en') AND list_contains(langs, 'th') AND list_contains(langs, 'ar') AS complete FROM g")
def _(spark, d):
    g = table(spark, d, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))  # as many as there are languages
    return g.select("source", (F.size(F.array_except(F.array(*map(F.lit, ("en", "th", "ar"))), "langs")) == 0).alias("complete"))


@query("preferred_parts", "SELECT p_brand, arg_max(p_partkey, (p_type = 'STANDARD', p_size, -p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.max_by("p_partkey", F.struct(F.col("p_type") == "STANDARD", "p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query("largest_devices", "SELECT s_nationkey, arg_max(s_name, (s_acctbal, s_name)) AS device, count(*) AS n FROM supplier GROUP BY s_nationkey")
def _(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_name", F.struct("s_acctbal", "s_name")).alias("device"), F.count("*").alias("n"))


@query("freshness", "WITH i AS (SELECT o_custkey, max(o_orderdate) AS newest, min(o_orderdate) AS made FROM orders GROUP BY o_custkey) SELECT o_custkey, newest >= made + INTERVAL 100 DAY AS stale, date_diff('day', made, newest) AS days FROM i")
def _(spark, d):
    i = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.min("o_orderdate").alias("made"))
    return i.select("o_custkey", (F.col("newest") >= F.col("made") + F.expr("INTERVAL 100 DAYS")).alias("stale"), F.date_diff("newest", "made").cast("bigint").alias("days"))


@query("error_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))


# Parts stand for exported files: name, size and time.
EXPORTS = """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'owl_adapter-f16.gguf' WHEN 1 THEN 'owl_vision-' || CASE p_size % 2 WHEN 0 THEN 'f16' ELSE 'q8_0' END || '.gguf' WHEN 2 THEN 'owlet_' || p_size || '.gguf' ELSE 'owl_notes.txt' END AS name FROM part)
"""


def exports(spark, d):
    k = F.col("p_partkey") % 4
    vision = F.concat(F.lit("owl_vision-"), F.when(F.col("p_size") % 2 == 0, "f16").otherwise("q8_0"), F.lit(".gguf"))
    name = F.when(k == 0, "owl_adapter-f16.gguf").when(k == 1, vision).when(k == 2, F.concat(F.lit("owlet_"), F.col("p_size").cast("string"), F.lit(".gguf"))).otherwise("owl_notes.txt")
    return table(spark, d, "part").select("p_partkey", name.alias("name"))


@query("export_prefix", EXPORTS + "SELECT name, count(*) AS n FROM f WHERE name LIKE '%.gguf' AND starts_with(name, 'owl_') GROUP BY name")
def _(spark, d):
    """The exports of one project among those of others: its base name without the ending, an underscore, and the format's suffix."""
    return state.exports_of(exports(spark, d), "owl_adapter").groupBy("name").agg(F.count("*").alias("n"))


@query("companions", EXPORTS + ", p AS (SELECT p_partkey // 40 AS project, name, p_partkey FROM f WHERE regexp_matches(name, '_vision-(f16|q8_0)[.]gguf$')) SELECT project, arg_max(name, (name LIKE '%-q8_0.gguf', -p_partkey)) AS companion, count(*) AS n FROM p GROUP BY project")
def _(spark, d):
    """Of each project's companion files the first, replaced by the first of the quantisation that is wanted."""
    f = exports(spark, d).withColumn("project", F.floor(F.col("p_partkey") / 40)).where(F.col("name").rlike(r"_vision-(f16|q8_0)\.gguf$"))
    return f.groupBy("project").agg(state.preferred("name", F.col("name").endswith("-q8_0.gguf"), F.col("p_partkey")).alias("companion"), F.count("*").alias("n"))


@query("headline_entries", LOG + ", e AS (SELECT run_id, step, CASE WHEN loss IS NOT NULL AND NOT isnan(loss) AND run_id < 'run_5' THEN ['loss'] ELSE [] END AS a, loss, val_cos, rate FROM log) SELECT run_id, step, CASE WHEN run_id < 'run_5' AND loss IS NOT NULL THEN 'loss' ELSE array_to_string(list_filter([CASE WHEN val_cos IS NOT NULL THEN 'val_cos' END, CASE WHEN rate IS NOT NULL THEN 'rate' END], lambda x: x IS NOT NULL), ' ') END AS keys FROM e")
def _(spark, d):
    """The keys a report shows: the recipe's own in its order, where it has any that are there, else all that are numbers, but for the time."""
    e = log(spark, d)
    named = F.when(F.col("run_id") < "run_5", F.array(F.lit("loss"))).otherwise(F.array().cast("array<string>"))
    values = F.create_map(*(x for k in ("loss", "val_cos", "rate", "time") for x in (F.lit(k), F.when((F.col("run_id") < "run_5") | (F.lit(k) != "loss"), F.col(k)))))
    return e.select("run_id", "step", F.array_join(state.headline(values, named, ("val_cos", "rate", "loss", "time")), " ").alias("keys"))


@query("in_flight", FILES + "SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(*) AS files, sum(found)::BIGINT AS bytes FROM files WHERE found IS NOT NULL AND NOT ok GROUP BY 1")
def _(spark, d):
    """Bytes of files that are there but not whole, for each folder."""
    part = files(spark, d).where("found is not null and not ok")
    return part.groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("found").alias("bytes"))
