"""Problem 4: copies hidden by layout, by radix partitioning on canonical bytes and tries that count.

The canonical bytes of a text are its copy key (see ``keys``). Buckets are prefixes of these bytes: a
bucket with more than BUCKET_BYTES in it, however large the corpus, is split by further bytes until each fits; hot keys can't be split
by bytes, so equal keys are folded in each batch before they are shuffled, and a bucket counts its
folded entries. The prefixes that are too large stand in a written table for each round, joined with the keys. Each bucket's trie holds, at the end of a key, the counter and the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import forms, keys
from skein.llm.records import digest_columns, identified, map_batches, salt_join, texts
from skein.session import Written

CLASS = ["tab", "k_hi", "k_lo"]
#: Bytes a bucket may hold before it is split, the bytes of the first round's prefix, and the bytes of prefixes that may be broadcast.
BUCKET_BYTES, STEP, MOST_BROADCAST = 16 << 20, 2, 8 << 20


class CountingTrie:
    """A path-compressed trie over byte strings; each terminal holds (smallest id, count)."""

    __slots__ = ("edges", "terminal")

    def __init__(self) -> None:
        self.edges: dict[int, list] = {}
        self.terminal: tuple[int, int] | None = None

    def add(self, key: bytes, smallest: int, count: int) -> None:
        node, at, end = self, 0, len(key)
        while at < end:
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = CountingTrie()
                leaf.terminal = (smallest, count)
                node.edges[key[at]] = [key[at:], leaf]
                return
            label, child = edge
            if key.startswith(label, at):
                at += len(label)
                node = child
                continue
            same = 1
            stop = min(len(label), end - at)
            while same < stop and label[same] == key[at + same]:
                same += 1
            middle = CountingTrie()
            middle.edges[label[same]] = [label[same:], child]
            node.edges[key[at]] = [label[:same], middle]
            node, at = middle, at + same
        had = node.terminal
        node.terminal = (smallest, count) if had is None else (min(had[0], smallest), had[1] + count)

    def terminals(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, smallest id, count) of every terminal."""
        todo: list[tuple[bytes, CountingTrie]] = [(b"", self)]
        while todo:
            prefix, node = todo.pop()
            if node.terminal is not None:
                yield prefix, *node.terminal
            todo.extend((prefix + label, child) for label, child in node.edges.values())


def with_key(rows: DataFrame) -> DataFrame:
    """(tab, id, k, k_hi, k_lo): canonical bytes of each text and their 128-bit digest.

    Null texts, texts without letter or digit, and rows without id or tab are left out.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found, keep = [], []
        for i, x in enumerate(b.column("text").to_pylist()):
            form = forms.visible_form(x)
            key = keys.keys_of_form(form)[1] if form else ""
            if key:
                keep.append(i)
                found.append(key.encode("utf-8", "surrogatepass"))
        hi, lo = digest_columns([xxhash.xxh3_128_digest(k) for k in found])
        kept = pa.array(keep, pa.int32())
        return pa.RecordBatch.from_arrays([b.column("tab").take(kept), b.column("id").take(kept), pa.array(found, pa.binary()), hi, lo], ["tab", "id", "k", "k_hi", "k_lo"])

    return map_batches(identified(rows).select("tab", "id", "text"), one, "tab string, id bigint, k binary, k_hi bigint, k_lo bigint")


def fold(rows: DataFrame) -> DataFrame:
    """(tab, k, k_hi, k_lo, id, n): rows with equal keys folded within each Arrow batch."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        t = pa.Table.from_batches([b])
        g = t.append_column("at", pa.array(range(len(t)), pa.int32())).group_by(CLASS).aggregate([("at", "min"), ("id", "min"), ("id", "count")])
        at = g["at_min"].combine_chunks()
        return pa.RecordBatch.from_arrays(
            [b.column("tab").take(at), b.column("k").take(at), b.column("k_hi").take(at), b.column("k_lo").take(at), g["id_min"].combine_chunks(), g["id_count"].combine_chunks()],
            ["tab", "k", "k_hi", "k_lo", "id", "n"],
        )

    return map_batches(rows, one, "tab string, k binary, k_hi bigint, k_lo bigint, id bigint, n bigint")


def too_large(keyed: DataFrame, out: Written, bucket_bytes: int = BUCKET_BYTES, step: int = STEP) -> list[tuple[int, DataFrame]]:
    """For prefixes of ``step``, 2 * ``step``, 4 * ``step`` ... bytes, (length, (p)) of those whose bucket is too large, up to the length at which all fit.

    Each round adds the bytes under the prefixes of one length, among the keys whose shorter prefix
    was too large. A key that ends within its prefix is in the bucket of that prefix, so the
    rounds end when only single keys are left in the buckets that are too large. Only the number of such prefixes comes to the driver.
    """
    under, length, found = keyed.select("k", "k_hi"), step, []
    while True:
        sums = under.groupBy(F.substring("k", 1, length).alias("p")).agg(F.sum(F.length("k") + 24).alias("bytes"), F.min("k_hi").alias("a"), F.max("k_hi").alias("b"))
        large = out.table(sums.where((F.col("bytes") > bucket_bytes) & (F.col("a") != F.col("b"))).select("p"), f"large_{length}")
        n = large.count()
        if not n:
            return found
        large = F.broadcast(large) if n * length <= MOST_BROADCAST else large
        found.append((length, large))
        under = under.join(large, F.substring("k", 1, length) == F.col("p"), "left_semi")
        length *= 2  # further bytes, twice as many each round: texts with long common beginnings take few rounds


def radix_bucket(rows: DataFrame, large: list[tuple[int, DataFrame]], step: int = STEP) -> DataFrame:
    """``rows`` with ``bucket``: the shortest prefix of the key whose bucket fits."""
    bucket: Column = F.substring("k", 1, 2 * large[-1][0] if large else step)
    marks = []
    for length, table in large:
        mark = f"_large_{length}"
        rows = rows.join(table.select(F.col("p").alias(f"_p_{length}"), F.lit(True).alias(mark)), F.substring("k", 1, length) == F.col(f"_p_{length}"), "left")
        marks.append((length, mark))
    for length, mark in reversed(marks):
        bucket = F.when(F.col(mark), bucket).otherwise(F.substring("k", 1, length))
    return rows.withColumn("bucket", bucket).drop(*(m for _, m in marks), *(f"_p_{n}" for n, _ in marks))


def count_in_tries(bucketed: DataFrame, least: int = 2) -> DataFrame:
    """(tab, k_hi, k_lo, id, n) for each key with at least ``least`` rows, from rows partitioned by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket, so one bucket's tries (one a tab) are held at a time.
        now, tries = None, {}

        def out() -> Iterator[pa.RecordBatch]:
            for tab, trie in tries.items():
                found = [x for x in trie.terminals() if x[2] >= least]
                hi, lo = digest_columns([xxhash.xxh3_128_digest(k) for k, _, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tab] * len(found), pa.string()), hi, lo, pa.array([i for _, i, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())],
                    ["tab", "k_hi", "k_lo", "id", "n"],
                )

        for b in batches:
            for bucket, tab, k, i, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "tab", "k", "id", "n"))):
                if bucket != now:
                    yield from out()
                    now, tries = bucket, {}
                if tab not in tries:
                    tries[tab] = CountingTrie()
                tries[tab].add(k, i, n)
        yield from out()

    return bucketed.mapInArrow(run, "tab string, k_hi bigint, k_lo bigint, id bigint, n bigint")


def copy_classes(rows: DataFrame, out: Written, bucket_bytes: int = BUCKET_BYTES, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rows with their class digest, classes of at least ``least`` rows).

    The first is (tab, id, k_hi, k_lo), the second (tab, k_hi, k_lo, id, n) with the smallest id.
    """
    keyed = out.table(with_key(rows), "keyed")
    large = too_large(keyed, out, bucket_bytes)
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = radix_bucket(fold(keyed).select("tab", "k", "id", "n"), large).select("tab", "k", "id", "n", "bucket").repartition(int(parts), "bucket").sortWithinPartitions("bucket")
    classes = out.table(count_in_tries(placed, least), "classes")
    out.keep("keyed", "classes")
    return keyed.select("tab", "id", "k_hi", "k_lo"), classes


def copies(rows: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pairs (tab, id_a, id_b): id_a the smallest id of a set of copies, id_b each other id of it.

    Null texts and texts without letter or digit are in no set. A row that is repeated with its id
    gives no pair with itself.
    """
    out = Written(rows.sparkSession, "p4")
    members, classes = copy_classes(rows, out, bucket_bytes)
    total = members.count()
    got = salt_join(members.withColumnRenamed("id", "id_b"), classes.withColumnRenamed("id", "id_a"), CLASS, "id_b", "n", total)
    return got.where("id_a < id_b").select("tab", "id_a", "id_b")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(texts(spark, sf_dir))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with letter or digit once, copies collapsed: (tab, id, n), the smallest id and the number of rows."""
    return copy_classes(texts(spark, sf_dir), Written(spark, "p4"), least=1)[1].select("tab", "id", "n")


QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts}
