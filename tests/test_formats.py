import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import corpus, encoders, layouts, stats
from skein.plans import training
from skein.sources import gguf, readers, sinks


def test_gguf_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(3)
    values = {"a.norm": rnd.standard_normal(8), "b": rnd.standard_normal((4, 64)), "c": rnd.standard_normal((2, 3)), "d": np.zeros((1, 32))}
    kinds = {"b": "q8_0", "c": "bf16", "d": "q8_0"}
    said = {"general.name": "owl", "n": 7, "big": 1 << 40, "low": -3, "rate": 0.5, "on": True, "list": [1, 2, 3], "words": ["a", "b"], "none": []}
    path = tmp_path / "x.gguf"
    assert gguf.write(values, said, path, kinds) == 4
    metadata, found = gguf.header(path)
    assert metadata == said and found["b"]["shape"] == [4, 64] and found["b"]["begin"] % gguf.ALIGN == 0
    got = {r.name: np.array(r.data).reshape(r.shape) for r in gguf.tensors(spark, [str(path)]).collect()}
    assert np.allclose(got["a.norm"], values["a.norm"], atol=1e-6) and np.allclose(got["c"], values["c"], rtol=1e-2)
    assert np.abs(got["b"] - values["b"]).max() <= np.abs(values["b"]).max() / 127 and not got["d"].any()
    assert gguf.recast(path, tmp_path / "y.gguf", lambda _, s: "f32" if len(s) == 1 else "f16", lambda n: n != "d") == 3
    assert {k: v["kind"] for k, v in gguf.header(tmp_path / "y.gguf")[1].items()} == {"a.norm": "f32", "b": "f16", "c": "f16"}
    with pytest.raises(ValueError, match="whole blocks"):
        gguf.quantised(np.zeros((2, 33)))
    (tmp_path / "z.gguf").write_bytes(b"no tensors")
    with pytest.raises(ValueError, match="no GGUF"):
        gguf.header(tmp_path / "z.gguf")


@pytest.fixture(scope="module")
def fit_rows(spark):
    rnd = np.random.default_rng(5)
    w, x = rnd.standard_normal((3, 2)), rnd.standard_normal((400, 3))
    rows = spark.createDataFrame([(i // 20, a.tolist(), (a @ w).tolist()) for i, a in enumerate(x)], "shard int, x array<double>, t array<double>").repartition(3).persist()
    return w, rows


def test_a_fit_resumes_as_if_it_had_not_stopped(fit_rows, tmp_path):
    w, rows = fit_rows
    settings = {"steps": 12, "block": 6, "rate": 0.1, "warm": 2, "log_every": 4, "save_every": 4}
    seen = []
    whole = training.train(rows, rows, str(tmp_path / "a"), settings, seen.append)
    half = training.train(rows, rows, str(tmp_path / "b"), settings | {"steps": 12, "save_every": 3}, lambda _: sinks.write_shared(f"{tmp_path}/b/STOP", b""))
    assert half.step == 4 and sinks.read_shared(f"{tmp_path}/b/STOP") is None and json.loads(sinks.read_shared(f"{tmp_path}/b/state.json"))["status"] == "stopped"
    again = training.train(rows, rows, str(tmp_path / "b"), settings)
    assert again.step == whole.step == 12 and np.allclose(again.w, whole.w, atol=1e-9)
    assert [x["step"] for x in seen] == [4, 8, 12] and seen[-1]["val"] < seen[0]["val"]
    assert training.load(str(tmp_path / "a"), "best").step in (4, 8, 12) and training.load(str(tmp_path), "none") is None


def test_snapshots_and_live_settings(fit_rows, tmp_path):
    _, rows = fit_rows
    sinks.write_shared(f"{tmp_path}/snapshot.request", b"")
    sinks.write_shared(f"{tmp_path}/live.json", b'{"steps": 4}')
    got = training.train(rows, rows, str(tmp_path), {"steps": 50, "log_every": 2, "block": 5})
    assert got.step == 4 and training.load(str(tmp_path), "snapshot-2").step == 2 and sinks.read_shared(f"{tmp_path}/snapshot.request") is None


def test_blocks_cover_an_epoch(fit_rows):
    _, rows = fit_rows
    each = [{r.shard for r in training.block_of(rows, 20, s, 6, 1).select("shard").distinct().collect()} for s in range(8)]
    assert sorted(x for s in each[:4] for x in s) == list(range(20)) and len(each[3]) == 2 and each[:4] != each[4:]


def test_state_is_written_at_most_once_a_second(spark, tmp_path):
    now = [0.0]
    t = training.Throttled(f"{tmp_path}/s.json", clock=lambda: now[0])
    assert t.write({"a": 1}) and not t.write({"a": 2}) and t.write({"a": 3}, "done")
    now[0] = 1.5
    assert t.write({"a": 4}) and json.loads(sinks.read_shared(f"{tmp_path}/s.json")) == {"a": 4}


def test_point_reads(spark, tmp_path):
    for name, files in (("one.zip", {"d/a.png": b"1", "b.png": b"2"}), ("two.zip", {"a.png": b"3", "x/": b"", "x/a.png": b"4"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
    keys = spark.createDataFrame([("a.png",), ("a.png",), ("none",)], "key string")
    got = readers.zip_members(spark, [str(tmp_path / "one.zip"), str(tmp_path / "two.zip")], keys).collect()
    assert [(r.key, bytes(r.content)) for r in got] == [("a.png", b"4")]
    spark.range(50).selectExpr("id", "array(concat(' cap ', id), '') AS c").coalesce(1).write.parquet(f"{tmp_path}/p")
    rows = readers.with_row_keys(spark, f"{tmp_path}/p").select("id", "key").collect()
    assert len({r.key for r in rows}) == 50 and all(r.key.endswith(f"-{r.id}") for r in rows)
    one = readers.rows_by_key(spark, f"{tmp_path}/p", spark.createDataFrame([(rows[7].key,)], "key string")).collect()
    assert [r.id for r in one] == [rows[7].id]
    assert readers.captions(spark, f"{tmp_path}/p", "parquet", caption="c").where(F.size("captions") == 1).count() == 50
    with pytest.raises(ValueError, match="no layout"):
        readers.captions(spark, str(tmp_path), "tar")


def test_guards(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "much too long")], "k int, text string")
    assert corpus.checked_length(rows, "text", 20, "k").count() == 2
    with pytest.raises(Exception, match="2 has 13 characters"):
        corpus.checked_length(rows, "text", 8, "k").collect()
    with pytest.raises(ValueError, match="too small"):
        corpus.check_size(107, 100, 8)
    with pytest.raises(ValueError, match="can't be paired"):
        stats.paired_tables(rows, rows.limit(1), "k")
    assert stats.paired_tables(rows, rows, "k").columns == ["k", "text", "text_r"]


def test_small_readers(spark):
    got = readers.devices(spark, "Card A, 24000, 1200, 15, 40\nCard B, 8000, N/A, 0, 30\nbroken").collect()
    assert [(r["index"], r.name, r.memory_used) for r in got] == [(0, "Card A", 1200.0), (1, "Card B", None)]
    assert readers.host(spark)["spark"] == spark.version
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.filled("run {x} {y}", x=F.col("x"), y=F.col("y")).alias("c")).first().c == "run a <y>"
    assert df.select(text.epoch_seconds(F.lit("1970-01-01 00:00:01.5")).alias("s")).first().s == 1.5


def test_gram_matrix_of_few_and_no_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],), (None,), ([3.0, 4.0],)], "v array<double>").repartition(3)
    assert {(r.i, r.j): r.value for r in stats.gram(df, "v").collect()} == {(0, 0): 10.0, (0, 1): 14.0, (1, 0): 14.0, (1, 1): 20.0}
    assert stats.gram(df.limit(0), "v").count() == 0


def test_layouts_round_trip(spark):
    rows = [(0, 0, [1, 2], [[0.5]], "a"), (0, 1, [], None, "b"), (1, 0, [3], [[1.0], [2.0]], None)]
    df = spark.createDataFrame(rows, "shard int, place int, ids array<int>, t array<array<double>>, text string").repartition(2)
    packed = layouts.pack(df, layouts.SEEDED)
    assert {r.shard: (r.n, list(r.ids_off), len(r.t_pack)) for r in packed.collect()} == {0: (2, [0, 2], 1), 1: (1, [0], 2)}
    got = {(r.shard, r.pos): (list(r.ids), list(map(list, r.t)), r.text) for r in layouts.unpack(packed, layouts.SEEDED).collect()}
    assert got == {(s, p): (i, t or [], x) for s, p, i, t, x in rows}
    old = layouts.pack(df.withColumn("starts", F.array().cast("array<int>")).withColumn("lens", F.array().cast("array<int>")).withColumn("v", F.array().cast("array<int>")), layouts.ALIGNED)
    old = old.drop("v_pack", "v_len", "v_off")
    assert all(r.v == [] for r in layouts.unpack(old, layouts.ALIGNED).collect()) and layouts.with_defaults(old, layouts.ALIGNED).where("not t_sparse").count() == 2


def test_segments_are_left_out_and_replaced(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [1, 4], [2, 1], [20, 30, 50]), ([1], [], [], [])], "r array<int>, s array<int>, n array<int>, v array<int>")
    got = df.select(layouts.without_segments(F.col("r"), F.col("s"), F.col("n")).alias("kept"), layouts.spliced(F.col("r"), F.col("s"), F.col("n"), F.col("v")).alias("full")).collect()
    assert [(list(x.kept), list(x.full)) for x in got] == [([1, 4, 6], [1, 20, 30, 4, 50, 6]), ([1], [1])]


def test_aligned_model_has_its_segments():
    a, b = encoders.mock_aligned()(["an owl", ""], [2, 0])
    assert a["starts"] == [1, 7] and all(a["ids"][p + k] == 0 for p in a["starts"] for k in range(encoders.IMAGE_SLOTS)) and len(a["v"]) == 10
    assert len(a["t"]) == len(a["ids"]) == 15 and b["ids"] == [1] and len(b["v"]) == 0


def test_commands_that_need_no_session(tmp_path):
    from skein.plans import pipeline

    run = lambda *a: pipeline.main([a[0], str(tmp_path), *a[1:]])
    run("snapshot"), run("set", "--settings", '{"a": {"b": 1}}'), run("set", "--settings", '{"a": {"c": 2}}'), run("stop")
    assert json.loads((tmp_path / "live.json").read_text()) == {"a": {"b": 1, "c": 2}} and (tmp_path / "snapshot.request").exists() and (tmp_path / "STOP").exists()
    for name in ("fit.npz", "map.safetensors", "eval.json"):
        (tmp_path / name).write_text("x")
    run("reset", "--only", "export")
    assert (tmp_path / "fit.npz").exists() and not (tmp_path / "map.safetensors").exists() and not (tmp_path / "eval.json").exists()
