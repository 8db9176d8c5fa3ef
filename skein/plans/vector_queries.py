"""Queries on vectors: moments, similarities, losses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.functions import vectors as v
from skein.operators import stats
from skein.plans.registry import query, table

PAIRS = "WITH p AS (SELECT a.vec_id, a.label, a.vec_id // 32 AS batch, list_transform(a.embedding, lambda x: x::DOUBLE) AS t, list_transform(b.embedding, lambda x: x::DOUBLE) AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)\n"
DIMS = "WITH x AS (SELECT vec_id, label, unnest(range(64))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)\n"
MOM = DIMS + ", m AS (SELECT dim, avg(x) AS mean, greatest(sum(x * x) / count(*) - avg(x) * avg(x), 1e-6) AS var, count(*) AS n FROM x GROUP BY dim)\n"
COS = "(list_dot_product(t, p) / greatest(sqrt(list_dot_product(t, t)) * sqrt(list_dot_product(p, p)), 1e-8))"
SQ = "list_sum(list_transform(range(1, 65), lambda i: (t[i] - p[i]) * (t[i] - p[i])))"


def emb(spark, d):
    return table(spark, d, "embeddings")


def pairs(spark, d):
    """Each vector as target with the next one as prediction."""
    e = emb(spark, d)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), v.doubles(F.col("embedding")).alias("p"))
    return e.select("vec_id", "label", F.floor(F.col("vec_id") / 32).alias("batch"), v.doubles(F.col("embedding")).alias("t")).join(nxt, "vec_id")


def moments(spark, d):
    return stats.merged_moments(stats.partial_moments(emb(spark, d), ["label"], "embedding"))


@query("moments_partial", DIMS + "SELECT label, dim, round(sum(x), 5) AS s, round(sum(x * x), 5) AS s2, count(*) AS n FROM x GROUP BY label, dim")
def _(spark, d):
    p = stats.partial_moments(emb(spark, d), ["label"], "embedding")
    return p.select("label", "dim", F.round("s", 5).alias("s"), F.round("s2", 5).alias("s2"), "n")


@query("moments_merged", MOM + "SELECT dim, round(mean, 6) AS mean, round(var, 6) AS var, round(sqrt(var), 6) AS sigma, round(1 / greatest(sqrt(var), 1e-3), 4) AS inv, n FROM m")
def _(spark, d):
    return moments(spark, d).select("dim", *(F.round(c, 6).alias(c) for c in ("mean", "var", "sigma")), F.round("inv", 4).alias("inv"), "n")


@query("sigma_summary", MOM + "SELECT round(min(sqrt(var)), 6) AS least, round(quantile_disc(sqrt(var), 0.5), 6) AS median, round(max(sqrt(var)), 6) AS most, count(*) FILTER (WHERE sqrt(var) < 0.12) AS below FROM m")
def _(spark, d):
    m = moments(spark, d)
    return m.agg(F.round(F.min("sigma"), 6).alias("least"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sigma)"), 6).alias("median"), F.round(F.max("sigma"), 6).alias("most"), F.count_if(F.col("sigma") < 0.12).alias("below"))


@query("whitened_rows", MOM + "SELECT vec_id, round(sum((x - mean) / sqrt(var)), 4) AS total, round(max((x - mean) / sqrt(var)), 4) AS most, round(sum(abs((x - mean) / sqrt(var) * sqrt(var) + mean - x)), 4) AS back FROM x JOIN m USING (dim) GROUP BY vec_id")
def _(spark, d):
    e = emb(spark, d).crossJoin(F.broadcast(stats.moment_arrays(moments(spark, d))))  # one row of moments
    w = e.select("vec_id", "embedding", "mu", "sd", v.standardise(F.col("embedding"), F.col("mu"), F.col("sd")).alias("z"))
    back = v.total(F.transform(v.subtract(v.unstandardise(F.col("z"), F.col("mu"), F.col("sd")), F.col("embedding")), F.abs))
    return w.select("vec_id", F.round(v.total(F.col("z")), 4).alias("total"), F.round(F.array_max("z"), 4).alias("most"), F.round(back, 4).alias("back"))


@query("gram_matrix", "SELECT i - 1 AS i, j - 1 AS j, round(sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE), 4) AS value FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL")
def _(spark, d):
    g = stats.gram(emb(spark, d), "embedding")
    return g.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("value", 4).alias("value"))


@query("cosine_next", PAIRS + f"SELECT vec_id, round({COS}, 6) AS cos FROM p")
def _(spark, d):
    return pairs(spark, d).select("vec_id", F.round(v.cosine(F.col("t"), F.col("p")), 6).alias("cos"))


@query("cosine_centred", PAIRS + ", m AS (SELECT list(a ORDER BY i) AS mu FROM (SELECT i, avg(t[i]) AS a FROM (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS t FROM embeddings), range(1, 65) r(i) GROUP BY i)), c AS (SELECT vec_id, list_transform(range(1, 65), lambda i: t[i] - mu[i]) AS t, list_transform(range(1, 65), lambda i: p[i] - mu[i]) AS p FROM p, m) " + f"SELECT vec_id, round({COS}, 5) AS cos FROM c")
def _(spark, d):
    q = pairs(spark, d).crossJoin(F.broadcast(stats.moment_arrays(moments(spark, d))))
    return q.select("vec_id", F.round(v.centred_cosine(F.col("t"), F.col("p"), F.col("mu")), 5).alias("cos"))


@query("rms_normed", "WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS t FROM embeddings) SELECT vec_id, round(list_sum(list_transform(t, lambda x: x / sqrt(list_dot_product(t, t) / 64 + 1e-5))), 5) AS total FROM t")
def _(spark, d):
    return emb(spark, d).select("vec_id", F.round(v.total(v.rms_norm(F.col("embedding"))), 5).alias("total"))


@query("unit_rows", "WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS t FROM embeddings) SELECT vec_id, round(list_sum(list_transform(t, lambda x: x / greatest(sqrt(list_dot_product(t, t)), 1e-12))), 5) AS total FROM t")
def _(spark, d):
    return emb(spark, d).select("vec_id", F.round(v.total(v.unit(F.col("embedding"))), 5).alias("total"))


@query("relative_errors", PAIRS + f", e AS (SELECT batch, label, {SQ} AS err, list_dot_product(t, t) AS sq FROM p), b AS (SELECT batch, sum(err) / greatest(sum(sq), 1e-8) AS r FROM e GROUP BY batch) SELECT (SELECT round(sum(err) / greatest(sum(sq), 1e-8), 6) FROM e) AS whole, (SELECT round(avg(r), 6) FROM b) AS of_batches, (SELECT round(sum(CASE WHEN label = 0 THEN err ELSE 0 END) / greatest(sum(CASE WHEN label = 0 THEN sq ELSE 0 END), 1e-8), 6) FROM e) AS of_first")
def _(spark, d):
    e = pairs(spark, d).select("batch", "label", v.squared_distance(F.col("t"), F.col("p")).alias("err"), v.dot(F.col("t"), F.col("t")).alias("sq"))
    first = lambda c: F.sum(F.when(F.col("label") == 0, F.col(c)).otherwise(0.0))
    b = e.groupBy("batch").agg(F.sum("err").alias("err"), F.sum("sq").alias("sq"), first("err").alias("err0"), first("sq").alias("sq0"))
    ratio = lambda x, y: F.sum(x) / F.greatest(F.sum(y), F.lit(1e-8))
    return b.agg(F.round(ratio("err", "sq"), 6).alias("whole"), F.round(F.avg(F.col("err") / F.greatest("sq", F.lit(1e-8))), 6).alias("of_batches"), F.round(ratio("err0", "sq0"), 6).alias("of_first"))


@query("cosine_summary", PAIRS + f", c AS (SELECT batch, label, {COS} AS cos FROM p), b AS (SELECT batch, avg(cos) AS m FROM c GROUP BY batch) SELECT (SELECT round(avg(m), 6) FROM b) AS of_batches, (SELECT round(avg(cos), 6) FROM c) AS of_rows, (SELECT round(sum(cos * label) / sum(label), 6) FROM c) AS weighted, (SELECT round(avg(cos) FILTER (WHERE label % 2 = 0), 6) FROM c) AS even, (SELECT round(avg(cos) FILTER (WHERE label % 2 = 1), 6) FROM c) AS odd, (SELECT round(least(1.0, min(cos)), 6) FROM c) AS worst, (SELECT round(0.5 * (avg(cos) FILTER (WHERE label % 2 = 0)) + 0.5 * (avg(cos) FILTER (WHERE label % 2 = 1)), 6) FROM c) AS macro")
def _(spark, d):
    c = pairs(spark, d).select("batch", "label", v.cosine(F.col("t"), F.col("p")).alias("cos"))
    even, odd = F.when(F.col("label") % 2 == 0, F.col("cos")), F.when(F.col("label") % 2 == 1, F.col("cos"))
    b = c.groupBy("batch").agg(
        F.avg("cos").alias("m"), F.sum("cos").alias("s"), F.count("cos").alias("n"), F.sum(F.col("cos") * F.col("label")).alias("w"), F.sum("label").alias("l"),
        F.sum(even).alias("es"), F.count(even).alias("en"), F.sum(odd).alias("os"), F.count(odd).alias("on"), F.min("cos").alias("lo"),
    )
    e, o = F.sum("es") / F.sum("en"), F.sum("os") / F.sum("on")
    r = lambda x, n: F.round(x, 6).alias(n)
    return b.agg(r(F.avg("m"), "of_batches"), r(F.sum("s") / F.sum("n"), "of_rows"), r(F.sum("w") / F.sum("l"), "weighted"), r(e, "even"), r(o, "odd"), r(F.least(F.lit(1.0), F.min("lo")), "worst"), r(0.5 * e + 0.5 * o, "macro"))


@query("slice_means", PAIRS + f", c AS (SELECT label, vec_id, {COS} AS cos FROM p WHERE vec_id >= 10) SELECT label, round(avg(cos), 6) AS cos, count(*) AS n FROM c GROUP BY label")
def _(spark, d):
    return pairs(spark, d).where("vec_id >= 10").groupBy("label").agg(F.round(F.avg(v.cosine(F.col("t"), F.col("p"))), 6).alias("cos"), F.count("*").alias("n"))


@query("worst_rows", PAIRS + f"SELECT label, round(min({COS}), 6) AS worst, arg_min(vec_id, {COS}) AS vec_id FROM p GROUP BY label")
def _(spark, d):
    return pairs(spark, d).withColumn("cos", v.cosine(F.col("t"), F.col("p"))).groupBy("label").agg(F.round(F.min("cos"), 6).alias("worst"), F.min_by("vec_id", "cos").alias("vec_id"))


@query("fit_quality", PAIRS + f", c AS (SELECT {COS} AS cos, {SQ} AS err, list_dot_product(t, t) AS sq FROM p) SELECT round(avg(cos), 6) AS mean, round(quantile_cont(cos, 0.05), 6) AS low, round(sum(err) / sum(sq), 6) AS rel FROM c")
def _(spark, d):
    c = pairs(spark, d).select(v.cosine(F.col("t"), F.col("p")).alias("cos"), v.squared_distance(F.col("t"), F.col("p")).alias("err"), v.dot(F.col("t"), F.col("t")).alias("sq"))
    return c.agg(F.round(F.avg("cos"), 6).alias("mean"), F.round(F.expr("percentile(cos, 0.05)"), 6).alias("low"), F.round(F.sum("err") / F.sum("sq"), 6).alias("rel"))


@query(
    "masked_losses",
    MOM + ", y AS (SELECT a.vec_id, sum(((a.x - b.x) / sqrt(var)) ** 2) AS white, sum((a.x - b.x) ** 2) AS plain, sum(a.x * b.x) / greatest(sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)), 1e-8) AS cos, CASE WHEN a.vec_id % 3 > 0 THEN 1 ELSE 0 END AS mask FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim JOIN m ON m.dim = a.dim GROUP BY a.vec_id) "
    "SELECT round(sum(white * mask) / (sum(mask) * 64) + 0.5 * (1 - sum(cos * mask) / sum(mask)), 5) AS whitened, round(sum(plain) / (count(*) * 64) + 0.5 * (1 - avg(cos)), 5) AS plain FROM y",
)
def _(spark, d):
    q = pairs(spark, d).crossJoin(F.broadcast(stats.moment_arrays(moments(spark, d)))).withColumn("mask", (F.col("vec_id") % 3 > 0).cast("int"))
    y = q.select("mask", stats.masked_loss(F.col("t"), F.col("p"), F.col("sd")).alias("white"), v.squared_distance(F.col("t"), F.col("p")).alias("plain"), v.cosine(F.col("t"), F.col("p")).alias("cos"))
    m = F.col("mask")
    whitened = F.sum(F.col("white") * m) / (F.sum(m) * 64) + 0.5 * (1 - F.sum(F.col("cos") * m) / F.sum(m))
    return y.agg(F.round(whitened, 5).alias("whitened"), F.round(F.sum("plain") / (F.count("*") * 64) + 0.5 * (1 - F.avg("cos")), 5).alias("plain"))


@query("linear_rows", "SELECT vec_id, round(0.5 * embedding[1]::DOUBLE - embedding[2]::DOUBLE + 0.1, 6) AS y0, round(embedding[3]::DOUBLE * 2 + embedding[64]::DOUBLE - 0.2, 6) AS y1 FROM embeddings")
def _(spark, d):
    w = [[0.0] * 64 for _ in range(2)]
    w[0][0], w[0][1], w[1][2], w[1][63] = 0.5, -1.0, 2.0, 1.0
    y = emb(spark, d).select("vec_id", v.linear(F.col("embedding"), w, [0.1, -0.2]).alias("y"))
    return y.select("vec_id", F.round(F.col("y")[0], 6).alias("y0"), F.round(F.col("y")[1], 6).alias("y1"))


@query("affine_fold", MOM + "SELECT x.vec_id, x.dim, round(sqrt(var) * x.x, 6) + 0.0::DOUBLE AS w, round(sqrt(var) * 0.5 + mean, 6) AS b FROM x JOIN m USING (dim)")
def _(spark, d):
    x = emb(spark, d).select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    got = x.join(F.broadcast(moments(spark, d)), "dim")  # a row a dimension
    return got.select("vec_id", "dim", (F.round(F.col("sigma") * F.col("x").cast("double"), 6) + F.lit(0.0)).alias("w"), F.round(F.col("sigma") * 0.5 + F.col("mean"), 6).alias("b"))


@query("gathered_rows", "WITH ids AS (SELECT sample_id, unnest(range(4)) AS k FROM train), g AS (SELECT sample_id, k, (sample_id * 7 + k) % 600 AS id FROM ids) SELECT sample_id, k::INT AS k, round(coalesce(e.embedding[1]::DOUBLE, 0), 6) AS first FROM g LEFT JOIN embeddings e ON e.vec_id = g.id")
def _(spark, d):
    g = table(spark, d, "train").select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("vec_id", (F.col("sample_id") * 7 + F.col("k")) % 600)
    e = emb(spark, d).select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    return g.join(e, "vec_id", "left").select("sample_id", "k", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("first"))


@query("paired_vocabulary", "SELECT count(*) AS n, count(b.vec_id) AS both, round(sum(list_dot_product(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE))), 4) AS s FROM embeddings a LEFT JOIN embeddings b ON a.vec_id = b.vec_id - 1")
def _(spark, d):
    b = emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return emb(spark, d).join(b, "vec_id", "left").agg(F.count("*").alias("n"), F.count("e2").alias("both"), F.round(F.sum(v.dot(F.col("embedding"), F.col("e2"))), 4).alias("s"))


@query("pca_quality")
def _(spark, d):
    """The variance kept by 1, 2, ... 16 components."""
    mean, top, _ = stats.principal_components(emb(spark, d), "embedding", 16)
    centred = emb(spark, d).select(v.subtract(F.col("embedding"), F.array(*map(F.lit, map(float, mean)))).alias("e"))
    score = centred.select(F.posexplode(v.linear(F.col("e"), top.tolist())).alias("component", "x"), v.dot(F.col("e"), F.col("e")).alias("all"))
    g = score.groupBy("component").agg((F.sum(F.col("x") * F.col("x")) / F.sum("all")).alias("part"))
    return g.withColumn("kept", F.sum("part").over(Window.orderBy("component")))  # a row a component


@query("ridge_quality")
def _(spark, d):
    """How well the next vector is told by a ridge map from this one."""
    w = stats.ridge(pairs(spark, d), "t", "p")
    got = pairs(spark, d).withColumn("y", v.linear(F.col("t"), w.T.tolist()))
    return got.agg(F.avg(v.cosine(F.col("y"), F.col("p"))).alias("cos"), (F.sum(v.squared_distance(F.col("y"), F.col("p"))) / F.sum(v.dot(F.col("p"), F.col("p")))).alias("rel"))


_THREE = PAIRS.replace("AS p FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "AS p, list_transform(c.embedding, lambda x: x::DOUBLE) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2")


def three(spark, d):
    """Target, prediction and the prediction of an older checkpoint, by position."""
    older = emb(spark, d).select((F.col("vec_id") - 2).alias("vec_id"), v.doubles(F.col("embedding")).alias("c"))
    return pairs(spark, d).join(older, "vec_id")


@query("checkpoint_gains", _THREE + f"SELECT label, count(*) AS n, round(avg({COS}), 6) AS cos, round(avg({COS.replace('p)', 'c)').replace('(p, ', '(c, ')}), 6) AS before, round(avg({COS} - {COS.replace('p)', 'c)').replace('(p, ', '(c, ')}), 6) AS gain FROM p GROUP BY label")
def _(spark, d):
    now, before = v.cosine(F.col("t"), F.col("p")), v.cosine(F.col("t"), F.col("c"))
    q = three(spark, d).select("label", now.alias("now"), before.alias("before"))
    return q.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("now"), 6).alias("cos"), F.round(F.avg("before"), 6).alias("before"), F.round(F.avg(F.col("now") - F.col("before")), 6).alias("gain"))


@query(
    "standardised_losses",
    MOM + "SELECT round(sum(((a.x - b.mean) / sqrt(var) - (c.x - b.mean) / sqrt(var)) ** 2 * (CASE WHEN a.label % 2 = 0 THEN 1 ELSE 0 END)) / (64 * count(DISTINCT CASE WHEN a.label % 2 = 0 THEN a.vec_id END)), 5) AS masked FROM x a JOIN x c ON c.vec_id = a.vec_id + 1 AND c.dim = a.dim JOIN m b ON b.dim = a.dim",
)
def _(spark, d):
    """Squared error of standardised rows over those that the mask lets through."""
    q = pairs(spark, d).where("label % 2 = 0").crossJoin(F.broadcast(stats.moment_arrays(moments(spark, d))))  # one row of moments
    z = lambda c: v.standardise(F.col(c), F.col("mu"), F.col("sd"))
    e = q.select(v.squared_distance(z("t"), z("p")).alias("err"))
    return e.agg(F.round(F.sum("err") / (64 * F.count("*")), 5).alias("masked"))


@query("gradient_norms", PAIRS + f"SELECT label, round(sum({SQ}), 4) AS loss, round(sqrt(sum(4 * {SQ})), 5) AS norm FROM p GROUP BY label")
def _(spark, d):
    """Summed loss of each group and the norm of its gradient by the predictions, 2 (p - t)."""
    q = pairs(spark, d).select("label", v.squared_distance(F.col("t"), F.col("p")).alias("err"))
    return q.groupBy("label").agg(F.round(F.sum("err"), 4).alias("loss"), F.round(F.sqrt(F.sum(4 * F.col("err"))), 5).alias("norm"))


@query("last_row_cosines", PAIRS + f"SELECT label, max(vec_id) AS vec_id, round(arg_max({COS}, vec_id), 6) AS cos FROM p GROUP BY label")
def _(spark, d):
    """The cosine of the last row of each group, where a sequence has its end mark."""
    q = pairs(spark, d).select("label", "vec_id", v.cosine(F.col("t"), F.col("p")).alias("cos"))
    return q.groupBy("label").agg(F.max("vec_id").alias("vec_id"), F.round(F.max_by("cos", "vec_id"), 6).alias("cos"))
