"""Queries of the corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import draws, text
from skein.functions.text import BLANKS
from skein.operators import corpus
from skein.operators.ranking import ranked
from skein.plans.registry import query, table
from skein.sources import readers, sinks
from skein.session import Written

N_VAL, SEED, FRACTION = 500, 8, 0.015


def norm(c: str) -> str:
    return f"trim(regexp_replace({c}, '{BLANKS}', ' ', 'g'))"


POOL = f"""WITH normal AS (SELECT src_ord, row_ord, prompt_id, source, {norm('text')} AS text FROM prompts),
kept AS (SELECT * FROM normal WHERE length(text) BETWEEN 8 AND 1200),
pool AS (SELECT src_ord, row_ord, prompt_id, source, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY src_ord, row_ord, prompt_id) AS k FROM kept) WHERE k = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || prompt_id), prompt_id) AS rn FROM pool),
split AS (SELECT *, CASE WHEN rn <= {N_VAL} THEN 'val' ELSE 'train' END AS split FROM ranked)
"""
CAPTIONS = """WITH latest AS (SELECT source, filename, arg_max(raw, (received_at, coalesce(raw, ''))) AS raw0, max(received_at) AS t FROM captions WHERE filename IS NOT NULL GROUP BY ALL),
one AS (SELECT source, filename, max(raw) AS raw FROM captions c JOIN latest l USING (source, filename) WHERE c.received_at = l.t GROUP BY ALL),
parsed AS (SELECT source, filename, CASE WHEN json_valid(raw) AND json_type(raw) = 'ARRAY' THEN list_filter(list_transform(CAST(raw AS JSON)::JSON[], lambda x: trim(x ->> '$')), lambda x: x IS NOT NULL AND x <> '') ELSE [] END AS captions FROM one)
"""


def pool(spark, d):
    rows = table(spark, d, "prompts").select("src_ord", "row_ord", "prompt_id", "source", "text")
    return corpus.first_wins(corpus.normalised(rows), order=("src_ord", "row_ord", "prompt_id"))


def split(spark, d, *columns):
    """The split with the columns that are needed beside its key: what is ranked is moved and written."""
    rows = pool(spark, d)
    return corpus.head_split(rows.select("prompt_id", *columns) if columns else rows, N_VAL, 1 << 60, SEED, "prompt_id")


def captions(spark, d):
    return readers.caption_lists(readers.latest(table(spark, d, "captions"), ["source", "filename"], "received_at", "raw"), "raw")


@query("corpus_normalised", f"SELECT prompt_id, text FROM (SELECT prompt_id, {norm('text')} AS text FROM prompts) WHERE length(text) BETWEEN 8 AND 1200")
def _(spark, d):
    return corpus.normalised(table(spark, d, "prompts")).select("prompt_id", "text")


@query("corpus_pool", POOL + "SELECT prompt_id, source, text FROM pool")
def _(spark, d):
    return pool(spark, d).select("prompt_id", "source", "text")


@query("corpus_contribution", POOL + "SELECT src_ord, source, count(*) AS n_new, sum(count(*)) OVER (ORDER BY src_ord, source)::BIGINT AS n_total FROM pool GROUP BY src_ord, source")
def _(spark, d):
    g = pool(spark, d).groupBy("src_ord", "source").agg(F.count("*").alias("n_new"))
    return g.withColumn("n_total", F.expr("sum(n_new) over (order by src_ord, source)"))  # a row a source


@query("corpus_prepared", POOL + "SELECT split, count(*) AS n, sum(length(text))::BIGINT AS chars, min(rn) AS first_rn, max(rn) AS last_rn, count(DISTINCT source) AS sources FROM split GROUP BY split")
def _(spark, d):
    return split(spark, d, "source", F.length("text").alias("chars")).groupBy("split").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.countDistinct("source").alias("sources")
    )


@query("corpus_split", POOL + "SELECT prompt_id, split, rn FROM split")
def _(spark, d):
    return split(spark, d, "source").select("prompt_id", "split", "rn")


@query("corpus_disjoint", POOL + "SELECT count(*) AS overlap FROM split a WHERE a.split = 'val' AND lower(a.text) IN (SELECT lower(text) FROM split WHERE split = 'train')")
def _(spark, d):
    s = Written(spark, "split").table(split(spark, d, F.lower("text").alias("k")), "keys")
    return s.where("split = 'val'").join(s.where("split = 'train'").select("k"), "k", "left_semi").agg(F.count("*").alias("overlap"))


@query("corpus_train_rest", POOL + "SELECT source, count(*) AS n FROM (SELECT prompt_id, source FROM split EXCEPT ALL SELECT prompt_id, source FROM split WHERE split = 'val') GROUP BY source")
def _(spark, d):
    s = Written(spark, "split").table(split(spark, d, "source"), "rows")
    return s.select("prompt_id", "source").exceptAll(s.where("split = 'val'").select("prompt_id", "source")).groupBy("source").agg(F.count("*").alias("n"))


@query(
    "corpus_blank_tail",
    POOL + f", sizes AS (SELECT split, count(*) AS n, min(rn) AS lo FROM split GROUP BY split), placed AS (SELECT s.split, text, rn - lo + 1 AS k, n, CASE WHEN split = 'val' THEN greatest(1, floor(n * {FRACTION})) ELSE floor(n * {FRACTION}) END AS blanks FROM split s JOIN sizes USING (split)) "
    "SELECT split, count(*) AS n, count(*) FILTER (WHERE k > n - blanks) AS n_blank, sum(CASE WHEN k > n - blanks THEN 0 ELSE length(text) END)::BIGINT AS chars FROM placed GROUP BY split",
)
def _(spark, d):
    s = Written(spark, "split").table(split(spark, d), "rows")
    out = None
    for name, lo, least in (("val", 0, 1), ("train", N_VAL, 0)):
        part = s.where(F.col("split") == name).withColumn("rn", F.col("rn") - lo)
        part = corpus.blank_tail(part, part.count(), FRACTION, least)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("n_blank"), F.sum(F.length("text")).alias("chars"))


@query(
    "corpus_blank_positions",
    f"WITH r AS (SELECT sample_id, row_number() OVER (ORDER BY md5('{SEED}|' || sample_id), sample_id) AS rn, count(*) OVER () AS n FROM train) SELECT sample_id FROM r WHERE rn <= greatest(1, floor(n * {FRACTION}))",
)
def _(spark, d):
    rows = table(spark, d, "train").select("sample_id")
    k = max(1, int(rows.count() * FRACTION))
    return ranked(rows.withColumn("o", draws.order_key(SEED, F.col("sample_id"))), ["o", "sample_id"]).where(F.col("rn") <= k).select("sample_id")


@query("texts_present", "SELECT 'prompts' AS tab, count(*) AS n FROM prompts WHERE text <> '' UNION ALL SELECT 'train', count(*) FROM train WHERE text <> '' UNION ALL SELECT 'documents', count(*) FROM documents WHERE text <> ''")
def _(spark, d):
    out = None
    for t in ("prompts", "train", "documents"):
        n = readers.column_or_first(table(spark, d, t), "text").select(F.lit(t).alias("tab")).groupBy("tab").agg(F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("texts_too_long", "SELECT prompt_id, length(text) AS n_chars, left(replace(text, chr(10), ' '), 60) AS preview FROM prompts WHERE length(text) > 400")
def _(spark, d):
    return table(spark, d, "prompts").where(F.length("text") > 400).select("prompt_id", F.length("text").cast("bigint").alias("n_chars"), text.preview(F.col("text")).alias("preview"))


@query("known_sources", "SELECT p.source, count(*) AS n FROM prompts p JOIN (VALUES ('mj_prompts'), ('sd_prompts'), ('vid_prompts'), ('nowhere')) r(source) USING (source) GROUP BY p.source")
def _(spark, d):
    registry = spark.createDataFrame([(x,) for x in ("mj_prompts", "sd_prompts", "vid_prompts", "nowhere")], "source string")
    return table(spark, d, "prompts").join(F.broadcast(registry), "source").groupBy("source").agg(F.count("*").alias("n"))


@query("lines_round_trip", "SELECT replace(replace(text, chr(13), ' '), chr(10), ' ') AS value, count(*) AS n FROM train WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "train").where("text is not null").select(F.regexp_replace("text", "\r", " ").alias("text"))
    return readers.lines(spark, sinks.write_lines(rows, "text", "round_trip")).groupBy("value").agg(F.count("*").alias("n"))


@query("records_round_trip", "SELECT sample_id, text, coalesce(len(images), 0) AS n_images FROM train WHERE text <> ''")
def _(spark, d):
    path = sinks.write_records(table(spark, d, "train").select("sample_id", "text", "images"), "round_trip")
    got = readers.records(spark, path, "sample_id bigint, text string, images array<string>")
    return got.where("text <> ''").select("sample_id", "text", F.coalesce(F.expr("cardinality(images)"), F.lit(0)).cast("bigint").alias("n_images"))


@query("caption_entries", CAPTIONS + "SELECT source, filename, len(captions) AS n, array_to_string(captions, ' / ') AS joined FROM parsed")
def _(spark, d):
    return captions(spark, d).select("source", "filename", F.size("captions").cast("bigint").alias("n"), F.array_join("captions", " / ").alias("joined"))


@query("caption_csv_scan", CAPTIONS + "SELECT source, filename, len(captions) AS n FROM parsed")
def _(spark, d):
    rows = readers.latest(table(spark, d, "captions"), ["source", "filename"], "received_at", "raw")
    got = readers.caption_csv(spark, sinks.write_csv(rows.select("source", "filename", "raw"), "captions"), "source string, filename string, raw string")
    return got.select("source", "filename", F.size("captions").cast("bigint").alias("n"))


_SKIP = ", ".join(f"'{w}'" for w in text.STOP_WORDS + text.LOOK_WORDS)
SUBJECTS = CAPTIONS + f""", subj AS (SELECT source, filename, captions, list_sort(list_filter(list_distinct(list_transform(captions, lambda c:
coalesce(list_filter(regexp_extract_all(lower(c), '[a-z][a-z''-]*'), lambda w: length(w) > 2 AND NOT list_contains([{_SKIP}], w))[1], 'subject'))), lambda s: s <> 'subject')) AS subjects FROM parsed)
"""


@query("caption_subjects", SUBJECTS + "SELECT source, filename, array_to_string(subjects, ' ') AS subjects FROM subj")
def _(spark, d):
    return captions(spark, d).select("source", "filename", F.array_join(corpus.subjects(F.col("captions")), " ").alias("subjects"))


def _u(seed: str, key: str) -> str:
    return f"(('0x' || substr(sha1('{seed}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_LADDER = "CASE " + " ".join(f"WHEN u < {b} THEN '{k}'" for b, k in corpus.KINDS) + " ELSE 'short' END"


def _pick(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + f"][floor(v * {len(words)})::INT + 1]"


@query(
    "instructions",
    SUBJECTS + f", drawn AS (SELECT *, source || '/' || filename AS k, {_u('kind', 'source || chr(47) || filename')} AS u, {_u('word', 'source || chr(47) || filename')} AS v, {_u('cap', 'source || chr(47) || filename')} AS c FROM subj WHERE len(captions) > 0), "
    f"kinds AS (SELECT *, {_LADDER} AS kind, captions[floor(c * len(captions))::INT + 1] AS caption, 'the ' || coalesce(subjects[1], 'subject') AS o FROM drawn) "
    f"SELECT source, filename, kind, CASE kind WHEN 'blank' THEN '' WHEN 'caption' THEN caption WHEN 'add' THEN 'Add ' || {_pick(corpus.THINGS)} || ' next to ' || o WHEN 'remove' THEN 'Take away ' || o WHEN 'replace' THEN 'Swap ' || o || ' for ' || {_pick(corpus.THINGS)} "
    f"WHEN 'restyle' THEN 'Turn it into ' || {_pick(corpus.STYLES)} WHEN 'background' THEN 'Put ' || o || ' in ' || {_pick(corpus.PLACES)} WHEN 'recolour' THEN 'Make ' || o || ' ' || {_pick(corpus.COLOURS)} WHEN 'styled' THEN caption || ', as ' || {_pick(corpus.STYLES)} "
    "ELSE array_to_string(string_split(caption, ' ')[1:4], ' ') END AS instruction FROM kinds",
)
def _(spark, d):
    rows = captions(spark, d).where(F.size("captions") > 0)
    key = F.concat_ws("/", "source", "filename")
    rows = rows.withColumn("kind", draws.ladder(draws.uniform("kind", key), corpus.KINDS, "short"))
    caption = draws.choice(F.col("captions"), draws.uniform("cap", key))
    rows = rows.withColumn("caption", caption).withColumn("subject", F.get(corpus.subjects(F.col("captions")), F.lit(0)))
    return rows.select("source", "filename", "kind", corpus.instruction(F.col("caption"), F.col("subject"), F.col("kind"), draws.uniform("word", key)).alias("instruction"))


@query(
    "image_pairs",
    "WITH r AS (SELECT source, filename, row_number() OVER (ORDER BY md5('8|' || source || '|' || filename), source, filename) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT source, filename FROM captions WHERE filename IS NOT NULL)), "
    f"d AS (SELECT i, floor({_u('8a', 'i')} * n)::BIGINT AS a, floor({_u('8b', 'i')} * (n - 1))::BIGINT AS b0 FROM (SELECT max(n) AS n FROM r), LATERAL (SELECT unnest(range(n)) AS i)), e AS (SELECT i, a, b0 + CASE WHEN b0 >= a THEN 1 ELSE 0 END AS b FROM d) "
    "SELECT i, x.source || '_' || x.filename AS first, y.source || '_' || y.filename AS second FROM e JOIN r x ON x.rn = a + 1 JOIN r y ON y.rn = b + 1",
)
def _(spark, d):
    assets = table(spark, d, "captions").where("filename is not null").select("source", "filename").distinct()
    r = Written(spark, "assets").table(ranked(assets.withColumn("o", draws.order_key(8, F.col("source"), F.col("filename"))), ["o", "source", "filename"]), "ranked")
    name = F.concat_ws("_", "source", "filename")
    n = r.count()
    pairs = corpus.random_pairs(n, n, 8, spark)
    first = r.select((F.col("rn") - 1).alias("a"), name.alias("first"))
    return pairs.join(first, "a").join(first.withColumnsRenamed({"a": "b", "first": "second"}), "b").select("i", "first", "second")


@query("round_robin", "WITH r AS (SELECT region, row_number() OVER (ORDER BY region) AS rn FROM (SELECT DISTINCT r_name AS region FROM region)) SELECT i, region FROM range(1000) t(i) JOIN r ON r.rn = i % (SELECT count(*) FROM r) + 1")
def _(spark, d):
    r = ranked(table(spark, d, "region").select(F.col("r_name").alias("region")).distinct(), ["region"])
    return corpus.round_robin(r, 1000, r.count()).select("i", "region")


@query("brackets_cleaned", f"SELECT prompt_id, {norm(chr(114) + 'egexp_replace(text, ' + chr(39) + '[()\\[\\]]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM prompts WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "prompts").where("text is not null").select("prompt_id", text.clean_brackets(F.col("text")).alias("text"))


@query("safe_names", "SELECT DISTINCT right(regexp_replace(source || '/' || filename, '[^A-Za-z0-9._-]+', '_', 'g'), 80) AS name FROM captions WHERE filename IS NOT NULL AND source IS NOT NULL")
def _(spark, d):
    return table(spark, d, "captions").where("filename is not null and source is not null").select(text.safe_name(F.concat_ws("/", "source", "filename")).alias("name")).distinct()


@query(
    "image_links",
    "WITH i AS (SELECT sample_id, unnest(images) AS path FROM train), c AS (SELECT DISTINCT 'images/' || source || '_' || filename AS path FROM captions) SELECT count(*) AS n, count(c.path) AS linked, count(DISTINCT i.path) AS files, count(*) - count(c.path) AS dangling FROM i LEFT JOIN c USING (path)",
)
def _(spark, d):
    i = table(spark, d, "train").select("sample_id", F.explode("images").alias("path"))
    c = table(spark, d, "captions").select(F.concat(F.lit("images/"), F.col("source"), F.lit("_"), F.col("filename")).alias("path")).distinct().withColumn("hit", F.lit(1))
    g = i.join(c, "path", "left").agg(F.count("*").alias("n"), F.count("hit").alias("linked"), F.countDistinct("path").alias("files"))
    return g.withColumn("dangling", F.col("n") - F.col("linked"))


@query(
    "sample_kinds",
    "SELECT split, count(*) AS n, count(*) FILTER (WHERE coalesce(len(images), 0) = 1) AS one_image, count(*) FILTER (WHERE len(images) = 2) AS two_images, count(*) FILTER (WHERE coalesce(len(images), 0) = 0) AS text_only, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty "
    "FROM (SELECT 'train' AS split, text, images FROM train UNION ALL SELECT split, text, images FROM val) GROUP BY split",
)
def _(spark, d):
    rows = table(spark, d, "train").select(F.lit("train").alias("split"), "text", "images").unionByName(table(spark, d, "val").select("split", "text", "images"))
    n = F.coalesce(F.expr("cardinality(images)"), F.lit(0))
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(n == 1).alias("one_image"), F.count_if(n == 2).alias("two_images"), F.count_if(n == 0).alias("text_only"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty")
    )


@query("first_words", "SELECT prompt_id, array_to_string(string_split(text, ' ')[1:greatest(2, 2 + prompt_id % 4)], ' ') AS head FROM prompts WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "prompts").where("text is not null").select("prompt_id", text.first_words(F.col("text"), (F.lit(2) + F.col("prompt_id") % 4).cast("int")).alias("head"))


@query("two_image_texts", "SELECT a.sample_id, 'Put {x} from image 1 beside ' || coalesce(a.text, '') AS text FROM train a WHERE len(a.images) = 2")
def _(spark, d):
    pattern = F.replace(F.lit("Put {cat} from image 1 beside {cap}"), F.lit("{cat}"), F.lit("{x}"))
    return table(spark, d, "train").where("cardinality(images) = 2").select("sample_id", F.replace(pattern, F.lit("{cap}"), F.coalesce("text", F.lit(""))).alias("text"))


SOURCES = f"""WITH u AS (SELECT 0 AS src_ord, row_ord, text FROM prompts UNION ALL SELECT 1, sample_id, text FROM train UNION ALL SELECT 2, doc_id, text FROM documents),
n AS (SELECT src_ord, row_ord, {norm('text')} AS text FROM u), k AS (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY src_ord, row_ord, text) AS k FROM n WHERE length(text) BETWEEN 8 AND 1200)
"""


@query("pooled_sources", SOURCES + "SELECT src_ord, row_ord, text FROM k WHERE k = 1")
def _(spark, d):
    """Prompts, training texts and documents as one pool, in this order; the first of equal texts stays."""
    p, t, c = (table(spark, d, n) for n in ("prompts", "train", "documents"))
    sources = [p.select("row_ord", "text"), t.select(F.col("sample_id").alias("row_ord"), "text"), c.select(F.col("doc_id").alias("row_ord"), "text")]
    return corpus.pool(sources).select("src_ord", "row_ord", "text")


_KIND = "CASE coalesce(len(images), 0) WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'two' END"


@query("mixed_samples", f"WITH k AS (SELECT {_KIND} AS kind, sample_id FROM train) SELECT kind, sample_id, row_number() OVER (ORDER BY md5('8|' || kind || '|' || sample_id), sample_id) AS place FROM k")
def _(spark, d):
    """Samples of one image, of two and of text alone, put together and shuffled."""
    n, t = F.coalesce(F.expr("cardinality(images)"), F.lit(0)), table(spark, d, "train")
    parts = [t.where(w).select(F.lit(kind).alias("kind"), "sample_id") for kind, w in (("image", n == 1), ("two", n > 1), ("text", n == 0))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return ranked(rows.withColumn("o", draws.order_key(8, F.col("kind"), F.col("sample_id"))), ["o", "sample_id"], "place").select("kind", "sample_id", "place")


@query("commands", "SELECT DISTINCT source, 'encode --student ' || coalesce(source, '<student>') || '.bin --extra ' || coalesce(split, '<extra>') AS command, strftime(max(ingested_at) OVER (PARTITION BY source, split), '%Y%m%d-%H%M%S') AS archived FROM prompts")
def _(spark, d):
    g = table(spark, d, "prompts").groupBy("source", "split").agg(F.max("ingested_at").alias("t"))
    command = text.filled("encode --student {student}.bin --extra {extra}", student=F.col("source"), extra=F.col("split"))
    return g.select("source", command.alias("command"), text.archive_suffix(F.col("t")).alias("archived")).distinct()
