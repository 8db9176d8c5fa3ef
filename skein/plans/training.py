"""A fit by steps over replayable blocks of shards: gradients in the tasks, parameters on the driver, and what a long run needs.

Each step takes the next block of shards in a keyed order of its epoch, so a run that resumes from a checkpoint sees what an uninterrupted one
would have seen. A checkpoint holds parameters, optimiser moments and position. Between steps the run looks for a STOP file,
a request for a snapshot, and new settings; its state is written at most once a second.
"""

from __future__ import annotations

import io
import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import draws
from skein.sources import sinks

DEFAULTS = {"steps": 100, "block": 4, "rate": 0.02, "warm": 10, "seed": 8, "log_every": 10, "save_every": 50}


@dataclass
class State:
    """Parameters and moments of Adam, and how many steps were taken."""

    w: np.ndarray
    m: np.ndarray
    v: np.ndarray
    step: int = 0
    best: float = math.inf

    @classmethod
    def new(cls, inputs: int, outputs: int) -> State:
        return cls(*(np.zeros((inputs, outputs)) for _ in range(3)))

    def update(self, gradient: np.ndarray, rate: float) -> None:
        self.step += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        self.w = self.w - rate * (self.m / (1 - 0.9**self.step)) / (np.sqrt(self.v / (1 - 0.999**self.step)) + 1e-8)


@dataclass
class Throttled:
    """Writes a state file at most once in ``seconds``, unless a status is given."""

    path: str
    seconds: float = 1.0
    clock: Callable[[], float] = time.monotonic
    last: float = field(default=-math.inf)

    def write(self, state: dict, status: str | None = None) -> bool:
        if status is None and self.clock() - self.last < self.seconds:
            return False
        self.last = self.clock()
        sinks.write_shared(self.path, json.dumps(state | ({"status": status} if status else {})).encode())
        return True


def save(folder: str, name: str, state: State, settings: dict) -> None:
    data = io.BytesIO()
    np.savez(data, w=state.w, m=state.m, v=state.v)
    sinks.write_shared(f"{folder}/{name}.npz", data.getvalue())
    sinks.write_shared(f"{folder}/{name}.json", json.dumps({"step": state.step, "best": state.best if math.isfinite(state.best) else None, "settings": settings}).encode())


def load(folder: str, name: str) -> State | None:
    """The checkpoint, or None if there is none or it is torn."""
    side, data = sinks.read_shared(f"{folder}/{name}.json"), sinks.read_shared(f"{folder}/{name}.npz")
    if side is None or data is None:
        return None
    got, arrays = json.loads(side), np.load(io.BytesIO(data))
    return State(arrays["w"], arrays["m"], arrays["v"], got["step"], math.inf if got["best"] is None else got["best"])


def losses(rows: DataFrame, w: np.ndarray) -> tuple[float, int, np.ndarray]:
    """(sum of squared errors, values, gradient of that sum) of the map ``w`` over rows (x, t); a task brings one partial sum."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, gradient = 0.0, 0, np.zeros_like(sent.value)
        for b in batches:
            if b.num_rows:
                x, t = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("x", "t"))
                error = x @ sent.value - t
                loss, n, gradient = loss + float((error**2).sum()), n + error.size, gradient + 2 * x.T @ error
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([n], pa.int64()), pa.array([gradient.ravel()], pa.list_(pa.float64()))], ["loss", "n", "g"])

    parts = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("t").cast("array<double>").alias("t")).mapInArrow(run, "loss double, n bigint, g array<double>").collect()
    return sum(p.loss for p in parts), sum(p.n for p in parts), sum((np.array(p.g) for p in parts), np.zeros(w.size)).reshape(w.shape)


def block_of(rows: DataFrame, shards: int, step: int, block: int, seed: int | str) -> DataFrame:
    """The rows of a step: ``block`` shards, the next ones in the epoch's keyed order of all ``shards``; a short last block ends an epoch."""
    a_epoch = -(-shards // block)
    epoch, at = divmod(step, a_epoch)
    order = draws.order_key(seed, F.lit(epoch), F.col("shard"))
    chosen = rows.select("shard").distinct().withColumn("_o", order).orderBy("_o", "shard").offset(at * block).limit(block).select("shard")
    return rows.join(F.broadcast(chosen), "shard")  # ``block`` shards


def rate_at(step: int, settings: dict) -> float:
    """Linear warm-up, then a cosine down to a tenth."""
    warm, total = settings["warm"], settings["steps"]
    if step < warm:
        return settings["rate"] * (step + 1) / warm
    return settings["rate"] * (0.1 + 0.45 * (1 + math.cos(math.pi * min(1.0, (step - warm) / max(1, total - warm)))))


def train(rows: DataFrame, val: DataFrame, folder: str, settings: dict | None = None, log: Callable[[dict], None] = lambda _: None) -> State:
    """Fits x W = t over rows (shard, x, t) and resumes from the folder's ``last`` checkpoint if it is there.

    Files in ``folder``: ``last``, ``best`` and ``snapshot-N`` checkpoints, ``state.json``, ``live.json`` (settings that replace the run's, read at each
    log step), ``snapshot.request`` (answered and removed), ``STOP`` (ends the run after a checkpoint, and is removed). Shards are told apart by ``shard``.
    """
    settings = DEFAULTS | (settings or {})
    first = rows.select(F.size("x").alias("x"), F.size("t").alias("t")).first()
    state = load(folder, "last") or State.new(first.x, first.t)
    shards = rows.select("shard").distinct().count()
    report = Throttled(f"{folder}/state.json")
    while state.step < settings["steps"]:
        if sinks.read_shared(f"{folder}/STOP") is not None:
            sinks.remove_shared(f"{folder}/STOP")
            save(folder, "last", state, settings)
            report.write({"step": state.step}, "stopped")
            return state
        loss, n, gradient = losses(block_of(rows, shards, state.step, settings["block"], settings["seed"]), state.w)
        state.update(gradient / max(1, n), rate_at(state.step, settings))
        at_log = state.step % settings["log_every"] == 0 or state.step == settings["steps"]
        if at_log:
            wrong, values, _ = losses(val, state.w)
            now = {"step": state.step, "loss": loss / max(1, n), "val": wrong / max(1, values)}
            log(now)
            if now["val"] < state.best:
                state.best = now["val"]
                save(folder, "best", state, settings)
            live = sinks.read_shared(f"{folder}/live.json")
            settings = settings | (json.loads(live) if live else {})
            if sinks.read_shared(f"{folder}/snapshot.request") is not None:
                save(folder, f"snapshot-{state.step}", state, settings)
                sinks.remove_shared(f"{folder}/snapshot.request")
            report.write(now)
        if state.step % settings["save_every"] == 0:
            save(folder, "last", state, settings)
    save(folder, "last", state, settings)
    report.write({"step": state.step}, "done")
    return state
