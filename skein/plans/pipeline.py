"""The stages of a project, in order: corpus, shards of val and train, fit, export, eval. What is done is told by the
artifacts and their contract, never by the state file."""

from __future__ import annotations

import argparse
import json
import shutil
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import vectors
from skein.operators import corpus, encoders, stats
from skein.operators.ranking import ranked
from skein.operators.shards import chunk
from skein.plans.recipes import RECIPES, Recipe, dotted, merged
from skein.sources import readers, sinks

DEFAULTS = {"corpus": {"n_val": 1_024, "n_train": 60_000, "blank": 0.015, "seed": 8, "min_chars": 8, "max_chars": 1200, "spare": 8}, "fit": {"penalty": 1e-4}, "eval": True}
STAGES = ("corpus", "shards_val", "shards_train", "fit", "export", "eval")
#: What a reset of a stage removes: its artifacts and those made from them.
RESETS = {s: STAGES[i:] for i, s in enumerate(STAGES)} | {"shards_val": ("shards_val", "eval")}


class Project:
    def __init__(self, spark: SparkSession | None, folder: str, recipe: str, settings: dict | None = None) -> None:
        self.spark, self.at, self.recipe = spark, Path(folder), RECIPES[recipe]
        self.settings = merged(DEFAULTS, settings or {})
        self.at.mkdir(parents=True, exist_ok=True)

    def path(self, stage: str) -> Path:
        return self.at / {"fit": "fit.npz", "export": "map.safetensors", "eval": "eval.json"}.get(stage, stage)

    def done(self, stage: str) -> bool:
        p = self.path(stage)
        if stage in ("corpus", "shards_val", "shards_train"):
            return sinks.is_current(str(p), self.recipe.contract) and (p / "_SUCCESS").exists()
        return p.exists() and all(self.path(s).exists() and self._time(s) <= p.stat().st_mtime for s in STAGES[: STAGES.index(stage)] if s != "eval")

    def _time(self, stage: str) -> float:
        p = self.path(stage)
        return ((p / "_SUCCESS") if p.is_dir() else p).stat().st_mtime

    def reset(self, stage: str) -> None:
        for s in RESETS[stage]:
            p = self.path(s)
            shutil.rmtree(p) if p.is_dir() else p.unlink(missing_ok=True)

    def run(self, source: DataFrame, only: str | None = None, force: bool = False, log: Callable[[str], None] = lambda _: None) -> dict:
        """Runs the stages that are not done (or ``only`` one; ``force`` does it again). A STOP file ends the run between stages."""
        state: dict = {"status": "running", "stages": {}}
        for stage in STAGES:
            if only and stage != only or stage == "eval" and not self.settings["eval"]:
                continue
            if (self.at / "STOP").exists():
                (self.at / "STOP").unlink()
                state["status"] = "stopped"
                break
            if self.done(stage) and not force:
                state["stages"][stage] = "kept"
                continue
            began = time.time()
            log(stage)
            try:
                getattr(self, f"_{stage}")(source)
            except Exception as e:
                state |= {"status": "failed", "error": str(e)[:500]}
                sinks.write_json(self.at / "state.json", state)
                raise
            state["stages"][stage] = {"seconds": round(time.time() - began, 2)}
        else:
            state["status"] = "done"
        sinks.write_json(self.at / "state.json", state)
        return state

    def _write(self, df: DataFrame, stage: str) -> None:
        df.write.mode("overwrite").parquet(f"file://{self.path(stage).resolve()}")
        sinks.mark(str(self.path(stage)), self.recipe.contract)

    def _read(self, stage: str) -> DataFrame:
        return self.spark.read.parquet(f"file://{self.path(stage).resolve()}")

    def _corpus(self, source: DataFrame) -> None:
        c = self.settings["corpus"]
        pool = corpus.pool([source], c["min_chars"], c["max_chars"])
        split = corpus.head_split(pool.withColumn("key", F.concat_ws("/", "src_ord", "row_ord")), c["n_val"], c["n_train"], c["seed"], "key")
        n = split.count()
        corpus.check_size(n, c["n_val"], c["spare"])
        val = corpus.blank_tail(split.where("split = 'val'"), c["n_val"], c["blank"], 1)
        train = split.where("split = 'train'").withColumn("rn", F.col("rn") - c["n_val"])
        train = corpus.blank_tail(train, n - c["n_val"], c["blank"]).withColumn("rn", F.col("rn") + c["n_val"])
        self._write(val.unionByName(train).select("split", "rn", "text"), "corpus")

    def _shards(self, split: str) -> None:
        rows = self._read("corpus").where(F.col("split") == split)
        rows = ranked(rows.withColumn("n", F.length("text")), ["n", "rn"], "place").withColumn("shard", chunk(F.col("place"), self.recipe.shard_size))
        t = encoders.encode(rows, self.recipe.teacher, "place").select("place", F.col("rows").alias("t"))
        s = encoders.encode(rows, self.recipe.student, "place").select("place", F.col("rows").alias("x"))
        self._write(rows.join(t, "place").join(s, "place").select("shard", "place", "text", "x", "t"), f"shards_{split}")

    def _shards_val(self, _: DataFrame) -> None:
        self._shards("val")

    def _shards_train(self, _: DataFrame) -> None:
        self._shards("train")

    def _fit(self, _: DataFrame) -> None:
        rows = stats.paired_rows(self._read("shards_train"), "x", "t", self.recipe.queries)
        part = self.path("fit").with_name("part.npz")
        np.savez(part, w=stats.ridge(rows, "x", "t", dotted(self.settings, "fit.penalty")))
        part.replace(self.path("fit"))

    def _export(self, _: DataFrame) -> None:
        sinks.write_tensors({"map.weight": np.load(self.path("fit"))["w"]}, self.path("export"))

    def _eval(self, _: DataFrame) -> None:
        data = readers.tensors(self.spark, [str(self.path("export"))]).first()
        w = np.array(data.data, np.float64).reshape(data.shape)
        shards = self._read("shards_val")
        val = stats.paired_rows(shards, "x", "t", self.recipe.queries).withColumn("y", vectors.linear(F.col("x"), w.T.tolist()))
        val = stats.split_rows(val, ["y", "t"], max(1, self.recipe.queries))
        err = F.sum(vectors.squared_distance(F.col("y"), F.col("t"))) / F.sum(vectors.dot(F.col("t"), F.col("t")))
        r = val.agg(F.avg(vectors.cosine(F.col("y"), F.col("t"))).alias("cos"), err.alias("rel"), F.count("*").alias("rows")).first()
        sinks.write_json(self.path("eval"), r.asDict() | {"n": shards.count()})


def recipe_of(name: str) -> Recipe:
    return RECIPES[name]


def main(argv: list[str] | None = None) -> int:
    """skein run|stop|snapshot|set|reset|status FOLDER --recipe NAME --prompts PARQUET [--settings JSON] [--only STAGE] [--force]

    ``set`` writes --settings to live.json, which a fit by steps reads while it runs; ``snapshot`` asks it for one; ``reset`` removes the artifacts of
    --only STAGE and of those behind it.
    """
    p = argparse.ArgumentParser(prog="skein", description=main.__doc__)
    p.add_argument("command", choices=["run", "stop", "snapshot", "set", "reset", "status"])
    p.add_argument("folder")
    p.add_argument("--recipe", default="fixed_rows", choices=sorted(RECIPES))
    p.add_argument("--prompts")
    p.add_argument("--settings", type=json.loads, help='over the defaults, as {"corpus": {"n_train": 120000}}')
    p.add_argument("--only", choices=STAGES)
    p.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "stop":
        Path(a.folder, "STOP").touch()
    elif a.command == "snapshot":
        Path(a.folder, "snapshot.request").touch()
    elif a.command == "set":
        sinks.write_json(Path(a.folder, "live.json"), merged(sinks.read_json(Path(a.folder, "live.json"), {}), a.settings or {}))
    elif a.command == "reset":
        Project(None, a.folder, a.recipe).reset(a.only or STAGES[0])
    elif a.command == "status":
        print(sinks.read_json(Path(a.folder, "state.json"), {"status": "idle"}))
    else:
        from skein.session import local_session

        spark = local_session()
        source = spark.read.parquet(a.prompts).select(F.col("row_ord"), F.col("text"))
        print(Project(spark, a.folder, a.recipe, a.settings).run(source, a.only, a.force, print))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
