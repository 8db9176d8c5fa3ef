"""Problem 8: mixing sources to target weights, as a Pfair schedule of blocks.

Each source is to give ``target_share`` of all tokens, but no more than ``max_repeats`` times its own.
Its documents, in hash order, form a stream that starts again when it ends; the stream is cut into
blocks of equal size. Block k of a source with weight w is released at k/w and due at (k+1)/w, in slots
of one block; the earliest deadline among the released blocks goes first, so at every point of the mix
each source is less than one block away from its share.

Blocks have BLOCK tokens, weights are exact and the schedule has a slot for each block, in a mix of any size.

Only sums for each source and hash bucket reach the driver: sources are those of the weights table, a bucket has some BUCKET_DOCS documents.
The driver runs through the schedule once and keeps how many blocks each source has had before each SPAN slots, which is all that the slots
behind depend on; the tasks make the spans they need again from that.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.p7_tokens import FOLDER, encoded, encoding
from skein.llm.records import read
from skein.session import Written

BLOCK, BUCKET_DOCS, LEAST_BUCKETS = 1_000, 100_000, 64
#: Slots from one mark of the schedule to the next, and spans that a worker keeps; no result depends on them.
SPAN, KEPT = 5_000, 64


def token_counts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """(doc_id, source, n): tokens of each document; null and empty texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in batches:
            n = [len(encoded(enc, x)[0]) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "n"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id bigint, source string, n bigint")


def pfair(weights: list[Fraction], slots: int, at: int = 0, done: list[int] | None = None, ends: list[int] | None = None) -> list[int]:
    """For each of ``slots`` slots from ``at`` on the source that gets it; -1 where none is released (only if the weights sum to less than 1).

    ``done`` are the blocks that the sources have had before, ``ends`` those they have in all (without end if not given).
    """
    up, low = [w.numerator for w in weights], [w.denominator for w in weights]
    wait = [(k * low[i] // up[i], i, k) for i, k in enumerate(done or [0] * len(weights)) if up[i] > 0 and not (ends and k >= ends[i])]
    heapq.heapify(wait)
    ready: list[tuple[int, int, int]] = []
    out = []
    for now in range(at, at + slots):
        while wait and wait[0][0] <= now:
            _, i, k = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(k + 1) * low[i] // up[i]), i, k))
        if not ready:
            out.append(-1)
            continue
        _, i, k = heapq.heappop(ready)
        out.append(i)
        if not (ends and k + 1 >= ends[i]):
            heapq.heappush(wait, ((k + 1) * low[i] // up[i], i, k + 1))
    return out


class Plan:
    """Targets of each source and the schedule; made on the driver from one row a source.

    If ``most`` is given, a schedule of that many slots is repeated in a mix of any size, with weights that are whole parts of it.
    """

    def __init__(self, weights: list[tuple[str, float, int]], sizes: dict[str, int], total: int, block: int, most: int | None = None, span: int = SPAN) -> None:
        self.target = {s: share for s, share, _ in weights}
        self.repeats = {s: cap for s, _, cap in weights}
        self.want = {s: min(round(share * total), cap * sizes.get(s, 0)) for s, share, cap in weights}
        self.rounds = {s: divmod(w, sizes[s]) if sizes.get(s) else (0, 0) for s, w in self.want.items()}
        whole = sum(self.want.values())
        self.block = block
        self.names = sorted(self.want)
        self.ends = np.array([-(-self.want[s] // block) for s in self.names], np.int64)
        self.slots = int(self.ends.sum())
        self.span = max(span, 4 * len(self.names))  # the marks take less room than the slots
        self.weights = [Fraction(self.want[s], whole) if whole else Fraction(0) for s in self.names]
        self.most, self._made = most, {}
        if most is None:
            self.marks = self._marks()
            return
        order = pfair([Fraction(n, most) for n in parts_of(self.weights, most)], most)
        self.slot_of = {s: [at for at, i in enumerate(order) if i == j] for j, s in enumerate(self.names)}

    def _marks(self) -> np.ndarray:
        """For each span the blocks that each source has had before it."""
        done, out = np.zeros(len(self.names), np.int64), []
        for at in range(0, self.slots, self.span):
            out.append(done)
            done = done + np.bincount(self._order(at, done), minlength=len(self.names))
        return np.array(out, np.int64).reshape(len(out), len(self.names))

    def _order(self, at: int, done: np.ndarray) -> list[int]:
        return pfair(self.weights, min(self.span, self.slots - at), at, done.tolist(), self.ends.tolist())

    def _slots_in(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of span ``m`` by source and time, and where each source's begin."""
        if m not in self._made:
            if len(self._made) >= KEPT:
                self._made.pop(next(iter(self._made)))
            order = np.array(self._order(m * self.span, self.marks[m]))
            by = np.argsort(order, kind="stable")
            self._made[m] = m * self.span + by, np.searchsorted(order[by], np.arange(len(self.names)))
        return self._made[m]

    def places(self, sources: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The slots of blocks, each of the source of that number. A document without tokens may stand behind the last block; it is put into that."""
        blocks = np.minimum(blocks, self.ends[sources] - 1)
        spans, out = np.empty(len(blocks), np.int64), np.empty(len(blocks), np.int64)
        for i in np.unique(sources).tolist():
            spans[sources == i] = np.searchsorted(self.marks[:, i], blocks[sources == i], side="right") - 1
        for m in np.unique(spans).tolist():
            here = spans == m
            by, first = self._slots_in(m)
            out[here] = by[first[sources[here]] + blocks[here] - self.marks[m, sources[here]]]
        return out

    def slot(self, source: str, k: int) -> int:
        """The slot of a source's block ``k``."""
        if self.most is None:
            return int(self.places(np.array([self.names.index(source)]), np.array([k]))[0])
        of = self.slot_of[source]
        return k // len(of) * self.most + of[k % len(of)]


def parts_of(weights: list[Fraction], n: int) -> list[int]:
    """``n`` parts by weights that sum to 1: each rounded down or up, at least one for a positive weight."""
    down = [max(1, math.floor(w * n)) if w > 0 else 0 for w in weights]
    rest = n - sum(down)
    for i in sorted(range(len(weights)), key=lambda i: weights[i] * n - down[i], reverse=rest > 0):
        if rest and down[i] > (rest < 0):
            down[i] += 1 if rest > 0 else -1
            rest -= 1 if rest > 0 else -1
    return down


def _weights(table: DataFrame) -> list[tuple[str, float, int]]:
    """A row for each source: the largest share and cap where it is repeated; none for null or non-positive ones."""
    rows = table.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m"))
    return sorted((r.source, float(r.w), int(r.m)) for r in rows.collect())


def mix(docs: DataFrame, weights: DataFrame, folder: str = FOLDER, block: int = BLOCK, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """(uses, shares).

    uses: (doc_id, source, n_tokens, uses, slots), a row for each document of a weighted source; ``slots`` are
    the slots in which its uses begin. Documents without tokens cost nothing and are used as often as those beside them.
    shares: (source, target_share, actual_share, tokens, target_tokens, repeats, documents, max_repeats); ``repeats`` is
    tokens used over tokens there are, ``actual_share`` the part of the mix, null if the mix is empty.
    """
    spark = docs.sparkSession
    out = Written(spark, "p8")
    counted = out.table(token_counts(docs, folder), "counted")
    buckets = max(LEAST_BUCKETS, counted.count() // BUCKET_DOCS)
    # A bucket is a range of the hash that orders the stream, so the order doesn't depend on their number.
    hash_ = F.xxhash64("doc_id", F.lit(seed))
    counted = counted.withColumn("bucket", F.shiftright((F.shiftright(hash_, 32) + F.lit(1 << 31)) * F.lit(buckets), 32).cast("int"))
    w = _weights(weights)
    sums = counted.groupBy("source", "bucket").agg(F.sum("n").alias("n")).where(F.col("source").isin([s for s, *_ in w]))
    parts = {(r.source, r.bucket): r.n for r in sums.collect()}
    total = counted.agg(F.sum("n")).first()[0] or 0
    sizes = {s: sum(n for (x, _), n in parts.items() if x == s) for s, *_ in w}
    plan = Plan(w, sizes, total, block)
    start = [(s, b, sum_) for s in plan.names for b, sum_ in _running(parts, s)]
    placed = spark.createDataFrame(start, "source string, bucket int, before bigint")
    of = spark.createDataFrame([(s, *plan.rounds[s], sizes[s]) for s in plan.names], "source string, full bigint, rest bigint, size bigint")
    within = Window.partitionBy("source", "bucket").orderBy(hash_, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("n").over(within), F.lit(0))
    # A document is in the last, partial round if its middle lies before the round's end.
    uses = (F.col("full") + ((2 * F.col("at") + F.col("n")) < 2 * F.col("rest")).cast("bigint")).cast("int")
    # Both tables have a row for each source of the weights (and bucket): bounded, so broadcast.
    laid = counted.join(F.broadcast(placed), ["source", "bucket"]).join(F.broadcast(of), "source").withColumn("at", at).withColumn("uses", uses)
    begins = F.expr(f"transform(sequence(0, uses - 1), r -> (at + r * size) div {plan.block})")
    blocks = F.when(F.col("uses") > 0, begins).otherwise(F.array().cast("array<bigint>"))
    sent = spark.sparkContext.broadcast(plan)  # a number a source for each SPAN slots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        number = {s: i for i, s in enumerate(p.names)}
        for b in batches:
            ends = np.append(0, np.cumsum(pc.list_value_length(b.column("blocks")).to_numpy(zero_copy_only=False)))
            owners = np.repeat(np.array([number[s] for s in b.column("source").to_pylist()], np.int64), np.diff(ends))
            found = p.places(owners, b.column("blocks").flatten().to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "n", "uses")), lists], ["doc_id", "source", "n_tokens", "uses", "slots"])

    used = laid.select("doc_id", "source", "n", "uses", blocks.alias("blocks")).mapInArrow(place, "doc_id bigint, source string, n_tokens bigint, uses int, slots array<bigint>")
    got = laid.groupBy("source").agg(F.sum(F.col("n") * F.col("uses")).alias("tokens"), F.count(F.when(F.col("uses") > 0, 1)).alias("documents"))
    given = spark.createDataFrame([(s, plan.target[s], plan.want[s], plan.repeats[s], sizes[s]) for s in plan.names], "source string, target_share double, target_tokens bigint, max_repeats int, size bigint")
    all_ = got.agg(F.sum("tokens").alias("mix"))
    shares = given.join(got, "source", "left").crossJoin(F.broadcast(all_)).select(  # one row
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.when(F.col("mix") > 0, F.col("mix"))).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "target_tokens", (F.coalesce("tokens", F.lit(0)) / F.when(F.col("size") > 0, F.col("size"))).alias("repeats"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeats",
    )
    return used, shares


def _running(parts: dict[tuple[str, int], int], source: str) -> list[tuple[int, int]]:
    at, out = 0, []
    for b in sorted(b for s, b in parts if s == source):
        out.append((b, at))
        at += parts[source, b]
    return out


def p8_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_weights"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_weights"))[1]


def p8_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, source, doc_id, use): the mix itself; read by slot, each use of a document stands in the slot in which it begins."""
    return p8_uses(spark, sf_dir).select(F.posexplode("slots").alias("use", "slot"), "source", "doc_id").select("slot", "source", "doc_id", "use")


QUERIES = {"p8_uses": p8_uses, "p8_shares": p8_shares, "p8_order": p8_order}
