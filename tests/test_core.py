import json
import math
import os
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import draws, geometry, text, vectors
from skein.operators import corpus, encoders, shards, state, stats
from skein.operators.ranking import ranked, running
from skein.plans import catalog, recipes
from skein.plans.pipeline import STAGES, Project
from skein.sources import readers, sinks

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(plain([r[c] for c in names]) for r in df.collect())
    if name not in catalog.oracle_sql():
        assert got
        return
    cur = duck.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == names
    assert got == sorted(plain([r[cols.index(c)] for c in names]) for r in cur.fetchall())


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.y for r in df.select("i", fn(F.col("c")).alias("y")).orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, [" a \x1c b ", "", None], "string", text.normalise) == ["a b", "", None]
    assert column(spark, ["12k", "20,000", "1_000", "x", "-5", "", None], "string", text.parse_steps) == [12000, 20000, 1000, None, None, None, None]
    assert column(spark, ["A photo of the old owl", "of the", None], "string", text.subject) == ["old", "subject", "subject"]
    assert column(spark, ["a/b.c.JPG", ".hid", "x"], "string", text.suffix) == [".jpg", "", ""]
    ids = column(spark, ["an owl", None], "string", lambda c: text.word_ids(c, 100, 4))
    assert ids == [[2 + zlib.crc32(b"an") % 98, 2 + zlib.crc32(b"owl") % 98, 1, 0], [1, 0, 0, 0]]


def test_numbers(spark):
    assert column(spark, [float("nan"), float("inf"), 1.5, None], "double", vectors.finite) == [None, None, 1.5, None]
    assert column(spark, [48, 80, 3], "int", lambda c: geometry.to_multiple(c, 32)) == [64, 64, 32]
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", lambda c: vectors.cosine(c, c)) == [1.0, 0.0]
    u = column(spark, list(range(2000)), "int", lambda c: draws.uniform(1, c))
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.03


def test_ranks_over_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    assert ranked(df, ["k"]).where("rn <> k + 1").count() == 0
    assert running(df, ["k"], F.col("k"), "s").where("s <> k * (k - 1) / 2").count() == 0
    assert ranked(df.limit(0), ["k"]).count() == 0


def test_first_wins_on_one_hot_key(spark):
    rows = spark.range(3000).selectExpr("0 AS src_ord", "2999 - id AS row_ord", "CASE WHEN id % 3 = 0 THEN concat('t', id) ELSE 'Same TEXT' END AS text")
    assert corpus.first_wins(rows).count() == 1001
    assert corpus.first_wins(rows).where("lower(text) = 'same text'").first().row_ord == 0


def test_greedy_batches(spark):
    budget, most = 12, 3
    for lens in ([], [1, 1, 1, 1], [5, 5, 5], [20, 30], [1, 2, 3, 4, 5, 6]):
        want, n = [], 0
        for x in lens:
            if n and n < most and (n + 1) * x <= budget:
                n += 1
            else:
                want += [n] if n else []
                n = 1
        want += [n] if n else []
        assert column(spark, [lens], "array<int>", lambda c: shards.token_batches(c, budget, most)) == [want]


def test_moments_merge(spark):
    x = np.random.default_rng(1).standard_normal((50, 4))
    df = spark.createDataFrame([(i % 3, r.tolist()) for i, r in enumerate(x)], "shard int, v array<double>")
    m = stats.merged_moments(stats.partial_moments(df, ["shard"], "v")).orderBy("dim").toPandas()
    assert np.allclose(m["mean"], x.mean(axis=0)) and np.allclose(m["var"], x.var(axis=0))
    w = stats.ridge(df.withColumn("y", vectors.linear(F.col("v"), [[1.0, 2.0, 0.0, 0.0]])), "v", "y", 0.0)
    assert np.allclose(w[:, 0], [1, 2, 0, 0], atol=1e-6)


def test_manifests(spark):
    want = spark.createDataFrame([("m", "a", 0), ("m", "b", 5), ("m", "c", 5)], "material string, path string, size bigint")
    there = spark.createDataFrame([("a", 9), ("b", 4)], "path string, size bigint")
    r = state.completeness(state.present(want, there)).first()
    assert (r.n, r.n_present, r.missing, r.complete) == (3, 1, ["b", "c"], False)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r.value for r in readers.lines(spark, str(tmp_path / "a.txt")).collect()] == ["one", "", "two"]
    (tmp_path / "bad.jsonl").write_text('{"text": "x"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.records(spark, str(tmp_path / "bad.jsonl"), "text string").collect()
    img = tmp_path / "img" / "sub"
    img.mkdir(parents=True)
    (img / "p.PNG").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 7, 9))
    (img / "p.txt").write_text("a cap\n\nmore\n")
    (img / "q.gif").write_bytes(b"x")
    assert [r.captions for r in readers.folder(spark, str(tmp_path / "img")).collect()] == [["a cap", "more"]]
    assert encoders.image_size((img / "p.PNG").read_bytes()) == (7, 9)
    values = {"b": np.arange(6, dtype=np.float32).reshape(2, 3), "a": np.array([1.5], np.float32)}
    sinks.write_tensors(values, tmp_path / "t.safetensors", {"b": "bf16"})
    got = {r.name: r for r in readers.tensors(spark, [str(tmp_path / "t.safetensors")], lambda n: n == "b").collect()}
    assert list(got) == ["b"] and list(got["b"].data) == [0, 1, 2, 3, 4, 5] and got["b"].shape == [2, 3]
    assert readers.header_bytes([str(tmp_path / "t.safetensors")]) == 16
    sinks.write_json(tmp_path / "s.json", {"k": 1})
    assert sinks.read_json(tmp_path / "s.json") == {"k": 1} and sinks.read_json(tmp_path / "no", 3) == 3
    assert readers.tail(str(tmp_path / "a.txt"), 4)["text"] == "\ntwo\n" and readers.tail(str(tmp_path / "a.txt"), 99)["text"].startswith("one")
    df = spark.createDataFrame([("k1", bytearray(b"xy")), ("k1", bytearray(b"xy"))], "key string, content binary")
    assert sinks.copy_assets(df, "key", "content", str(tmp_path / "out")).count() == 1 and (tmp_path / "out" / "k1").read_bytes() == b"xy"
    with pytest.raises(FileNotFoundError):
        readers.shard_files(str(tmp_path))
    part = spark.createDataFrame([("train", 0, "x")], "split string, shard int, text string")
    sinks.write_shards(part, str(tmp_path / "sh"), "c1")
    assert sinks.is_current(str(tmp_path / "sh"), "c1") and not sinks.is_current(str(tmp_path / "sh"), "c2")


def test_captions_that_are_broken(spark):
    raw = ['["a", " ", null, " b "]', "[", "{}", None, "[]"]
    got = readers.caption_lists(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [r.captions for r in got] == [["a", "b"], [], [], [], []]


def test_images():
    x = np.random.default_rng(0).random((9, 6, 3)).astype(np.float32)
    assert encoders.patches(x, 3).shape == (6, 27) and np.allclose(encoders.cell_means(x, 3)[0], x[:3, :3].mean(axis=(0, 1)))
    assert encoders.crop_and_normalise(x, 4).shape == (4, 4, 3) and encoders.over_white(np.zeros((1, 1, 4))).max() == 1.0


def test_pipeline_resumes(spark, tmp_path):
    source = spark.read.parquet(f"{DATA}/prompts.parquet").select("row_ord", "text")
    p = Project(spark, str(tmp_path), "fixed_rows", {"corpus": {"n_val": 40, "n_train": 200}})
    assert p.run(source)["status"] == "done"
    assert json.loads((tmp_path / "eval.json").read_text())["n"] == 40
    assert set(p.run(source)["stages"].values()) == {"kept"}
    p.reset("fit")
    assert [p.done(s) for s in STAGES] == [True, True, True, False, False, False]
    (tmp_path / "STOP").touch()
    assert p.run(source)["status"] == "stopped"
    assert set(p.run(source, only="fit")["stages"]) == {"fit"}


def test_all_rows_are_used(spark, tmp_path):
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/train.parquet").select("text").collect()]
    v = np.concatenate(encoders.mock_rows()(texts))
    m = catalog.queries()["teacher_rows"](spark, DATA).orderBy("dim").toPandas()
    assert (m["n"] == 4 * len(texts)).all() and np.allclose(m["mean"], v.mean(axis=0), atol=1e-5)
    source = spark.read.parquet(f"{DATA}/prompts.parquet").select("row_ord", "text")
    for recipe, queries in (("fixed_rows", 4), ("word_rows", 1)):
        p = Project(spark, str(tmp_path / recipe), recipe, {"corpus": {"n_val": 20, "n_train": 60}})
        p.run(source)
        val = [r.text for r in p._read("shards_val").collect()]
        words = list(map(len, encoders.mock_tokens()(val)))
        got = json.loads((tmp_path / recipe / "eval.json").read_text())
        assert (got["n"], got["rows"]) == (20, sum(words) * queries)
        x = [encoders.mock_tokens()([r.text])[0].astype(float) for r in p._read("shards_train").select("text").collect()]
        t = [(p.recipe.teacher()([r.text])[0]).astype(float) for r in p._read("shards_train").select("text").collect()]
        a = np.concatenate(x)
        b = np.concatenate([np.tile(y.ravel(), (len(z), 1)) for z, y in zip(x, t)]) if queries > 1 else np.concatenate(t)
        g = a.T @ a
        assert np.allclose(np.load(p.path("fit"))["w"], np.linalg.solve(g + 1e-4 * np.trace(g) / 16 * np.eye(16), a.T @ b), atol=1e-4)


def test_corpus_has_blanks_and_the_sizes_of_its_settings(spark, tmp_path, monkeypatch):
    from skein import session
    from skein.plans import pipeline

    assert (pipeline.DEFAULTS["corpus"]["n_val"], pipeline.DEFAULTS["corpus"]["n_train"]) == (1_024, 60_000)
    monkeypatch.setattr(session, "local_session", lambda: spark)
    settings = '{"corpus": {"n_val": 40, "n_train": 130, "blank": 0.1}}'
    pipeline.main(["run", str(tmp_path), "--prompts", f"{DATA}/prompts.parquet", "--settings", settings, "--only", "corpus"])
    got = spark.read.parquet(f"{tmp_path}/corpus").groupBy("split").agg(F.count("*").alias("n"), F.sum(F.when(F.col("text") == "", 1)).alias("blank"), F.countDistinct("rn").alias("places"))
    assert {r.split: (r.n, r.blank, r.places) for r in got.collect()} == {"val": (40, 4, 40), "train": (130, 13, 130)}


def test_recipes():
    assert recipes.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert recipes.dotted({"a": {"b": 1}}, "a.b") == 1 and recipes.dotted({}, "a.b", 0) == 0
    with pytest.raises(ValueError):
        recipes.register(recipes.RECIPES["fixed_rows"])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())
