"""Problem 5: held-out records that also stand, as they are or slightly changed, in the training rows.

*Chunks.* The words of a normalised record, in reading order, are cut where a rolling hash of the last WINDOW words says so, so the
cuts depend on content alone and an edit moves only those beside it. A chunk's digest covers its words in order. Digests
are joined across the splits, and the lengths of the shared chunks, summed, over a record's length are its overlap fraction.
*Common chunks.* A digest that more than MANY held-out records have is posted with its next chunk, and so on to DEPTH chunks, so no
pair of long lists is made of common phrases; records of few words post it alone too. What is still long is split into blocks (``near``).
*Check.* A pair of records that share a chunk is kept if it is a copy or near by the sets of words.
*Rest.* A pair may be near by its words and share no chunk: words were moved, or each chunk holds an edit. Chunks find 7,274 of the 7,278
pairs of different texts in a corpus of 778,000; since no link may be lost, the lists of problem 2's coordinates, posted across the splits,
are merged in the same join and give the others. ``p5_overlaps`` says of each pair whether chunks or words alone found it, and ``p5_paths`` counts them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import forms, keys, near
from skein.llm.records import digest_columns, identified, in_classes, map_batches, read, salt_join
from skein.session import Written

#: Words of the rolling hash, bits of it that are zero at a cut (a chunk has 2**CUT_BITS words on average), held-out
#: records that may have a digest, chunks of a digest, words of a record that
#: posts common digests alone too, and words of one whose repeated chunks are sought.
WINDOW, CUT_BITS, MANY, DEPTH, FEW, REPEATS = 1, 1, 150, 3, 8, 64
BASE = 0x9E3779B97F4A7C15


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, id, held, text): prompts of the splits validation and test are held out, and all of val; a null split is training."""
    prompts = read(spark, sf_dir, "prompts").select(
        F.lit("prompts").alias("tab"), F.col("prompt_id").alias("id"), F.coalesce(F.col("split").isin("validation", "test"), F.lit(False)).alias("held"), "text"
    )
    both = [read(spark, sf_dir, t).select(F.lit("train").alias("tab"), F.col("sample_id").alias("id"), F.lit(t == "val").alias("held"), "text") for t in ("train", "val")]
    return prompts.unionByName(both[0]).unionByName(both[1]).where("text is not null")


def shape(rows: DataFrame) -> DataFrame:
    """(tab, id, held, k_hi, k_lo, seq): copy-key digest and the 32-bit hashes of each text's words, in reading order.

    The hashes are bytes that sort as the signed numbers do (``ordered``).

    Null texts, texts without letter or digit, and rows without id or tab are left out; a null ``held`` is false.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, digests, flat, ends = [], [], [], [0]
        known = near.WordHashes()
        for i, x in enumerate(b.column("text").to_pylist()):
            form = forms.visible_form(x)
            seq, key = keys.keys_of_form(form) if form else ("", "")
            if not key:
                continue
            keep.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
            flat.extend(map(known.__getitem__, keys.sequence_of(seq)))
            ends.append(len(flat))
        hi, lo = digest_columns(digests)
        kept = pa.array(keep, pa.int32())
        seqs = near.packed(ordered(np.array(flat, np.uint32)), np.array(ends))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(kept) for c in ("tab", "id", "held")), hi, lo, seqs], ["tab", "id", "held", "k_hi", "k_lo", "seq"])

    return map_batches(identified(rows).select("tab", "id", F.coalesce("held", F.lit(False)).alias("held"), "text"), one, "tab string, id bigint, held boolean, k_hi bigint, k_lo bigint, seq binary")


def ordered(words: np.ndarray) -> np.ndarray:
    """32-bit words as bytes that sort as the signed numbers do."""
    return (words ^ np.uint32(1 << 31)).byteswap()


def in_order(words: np.ndarray) -> np.ndarray:
    """The words of ``ordered``, as signed numbers."""
    return (words.byteswap() ^ np.uint32(1 << 31)).view(np.int32)


def classes_of(shaped: DataFrame) -> DataFrame:
    """One row per set of copies: (t, id, k_hi, k_lo, n, n_held, seq, words); copies may differ in the order of their fields, one order is taken.

    The digest comes first in the key, since rows are sorted by it; ``seq`` and ``words`` are packed.
    """
    g = shaped.groupBy("k_hi", "k_lo", "tab").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.sum(F.col("held").cast("long")).alias("n_held"), F.min("seq").alias("seq")
    )
    names = ["t", "id", "k_hi", "k_lo", "n", "n_held", "seq"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        seq, offsets = near.unpacked(b.column("seq"), np.uint32)
        seq = in_order(seq)
        words, off = word_sets(seq, offsets)
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), near.packed(seq, offsets), near.packed(words, off)], [*names, "words"])

    rows = g.select((F.col("tab") == "train").cast("byte").alias("t"), *names[1:])
    return map_batches(rows, one, "t byte, id bigint, k_hi bigint, k_lo bigint, n bigint, n_held bigint, seq binary, words binary")


def _record_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def word_sets(seq: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): the different words of each sequence, sorted."""
    each = np.unique(_record_of(offsets).astype(np.uint64) << np.uint64(32) | seq.view(np.uint32).astype(np.uint64))
    sizes = np.bincount((each >> np.uint64(32)).astype(np.int64), minlength=len(offsets) - 1)
    return (each & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def chunks(seq: np.ndarray, offsets: np.ndarray, window: int = WINDOW, cut_bits: int = CUT_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, digest, words) of the chunks of word sequences, in reading order."""
    rec, n = _record_of(offsets), len(seq)
    words = near.mix(seq.view(np.uint32), np.full(1, 7, np.uint64))
    rolling = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for back in range(window):  # sum of base**back * word, over the words of the window that are in the record
            of = np.concatenate([np.zeros(min(back, n), np.uint64), words[: max(0, n - back)]])
            of[np.arange(n) - offsets[rec] < back] = 0
            rolling += of * np.uint64(pow(BASE, back, 1 << 64))
    last = np.zeros(n, bool)
    last[offsets[1:] - 1] = True  # no record is empty
    end = np.flatnonzero((rolling >> np.uint64(64 - cut_bits) == 0) | last) if cut_bits else np.arange(n)
    first = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    size = end - first + 1
    at = np.arange(n) - np.repeat(first, size)
    return rec[first], np.add.reduceat(near.mix(words, at.astype(np.uint64)), first) if n else np.zeros(0, np.uint64), size


def digests(t: np.ndarray, seq: np.ndarray, offsets: np.ndarray, most: int, tables: list[tuple[near.BitTable, near.BitTable]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, record, value) of the digests of 1 to ``most`` chunks in reading order; with ``tables``, only those whose shorter ones are common."""
    rec, digest, _ = chunks(seq, offsets)
    key, at = near.mix(digest, t[rec].astype(np.uint64)), np.arange(len(rec))
    for depth in range(1, most + 1):
        yield depth, rec[at], key
        if tables:
            hot = tables[depth - 1][1].has(key)
            at, key = at[hot], key[hot]
        to = np.minimum(at + depth, len(rec) - 1)
        on = (at + depth < len(rec)) & (rec[to] == rec[at])
        at, key = at[on], near.mix(key[on], digest[to[on]])


def held_tables(held: DataFrame, out: Written, many: int = MANY, most: int = DEPTH) -> list[tuple[near.BitTable, near.BitTable]]:
    """For digests of 1 to ``most`` chunks, those of held-out records that are rare and those that are common, as bit tables."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        seq, offsets = near.column_of_arrays(b, "seq")
        got = list(digests(b.column("t").to_numpy(zero_copy_only=False), seq, offsets, most))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(k), d, np.int8) for d, _, k in got])), pa.array(np.concatenate([k for *_, k in got]).view(np.int64))], ["depth", "key"])

    found = map_batches(held.select("t", "seq"), one, "depth byte, key bigint").groupBy("depth", "key").agg(F.count("*").alias("n"))
    counted = out.table(found.select("depth", "key", (F.col("n") > many).alias("common")), "digests")
    sizes = {(d, c): 0 for d in range(1, most + 1) for c in (False, True)}
    sizes |= {(r.depth, r.common): r.n for r in counted.groupBy("depth", "common").agg(F.count("*").alias("n")).collect()}
    tables = near.bit_tables(counted, sizes, ["depth", "common"])
    out.drop("digests")
    return [(tables[d, False], tables[d, True]) for d in range(1, most + 1)]


def chunk_family(shared: Broadcast, few: int = FEW) -> near.Family:
    """The postings of each record under the digests that held-out records have; those are left, records with training rows right."""

    def family(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not b.num_rows:
            return (np.zeros(0, np.int64),) * 3
        seq, offsets = near.column_of_arrays(b, "seq")
        words, off = near.column_of_arrays(b, "words")
        t, flags = b.column("t").to_numpy(zero_copy_only=False), near.side_flags(b)
        short = np.diff(off) <= few
        recs, keys_ = [], []
        for depth, rec, key in digests(t, seq, offsets, len(shared.value), shared.value):
            rare, common = shared.value[depth - 1]
            often = common.has(key)
            hit = (rare.has(key) & ~often) | (often & (short[rec] | (depth == len(shared.value))))
            recs.append(rec[hit])
            keys_.append(key[hit])
        rec, key = np.concatenate(recs), np.concatenate(keys_)
        long = (np.diff(offsets) > REPEATS)[rec]
        if long.any():  # a chunk that a long record repeats is posted once; in a short one it does no harm
            _, once = np.unique(near.mix(key[long], rec[long].astype(np.uint64)), return_index=True)
            rec, key = np.concatenate([rec[~long], rec[long][once]]), np.concatenate([key[~long], key[long][once]])
        return rec, *near.posting_columns(key, rec, near.parities(words, off)[0], np.diff(off), t, flags[rec] | np.uint64(near.MARK | near.CHUNK))

    return family


def chunk_overlaps(pairs: DataFrame) -> DataFrame:
    """``pairs`` with sequences seq_a and seq_b as (t, id_a, id_b, path, o_a, o_b): the parts of each record's words that stand in shared chunks.

    Where no chunk is shared, it is the part of the different words.
    """
    names = ["t", "id_a", "id_b", "path"]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, cut, size = b.num_rows, [], []
        for c in ("seq_a", "seq_b"):
            seq, offsets = near.column_of_arrays(b, c)
            rec, digest, words = chunks(seq, offsets)
            cut.append((rec, near.mix(digest, rec.astype(np.uint64)), words, np.diff(offsets)))
            size.append(np.diff(word_sets(seq, offsets)[1]))
        shared = b.column("shared").to_numpy(zero_copy_only=False)
        parts = []
        for (rec, key, words, length), (_, other, _, _), different in zip(cut, cut[::-1], size):
            part = np.bincount(rec, np.where(np.isin(key, other), words, 0), minlength=n)[:n] / np.maximum(length, 1)
            parts.append(pa.array(np.where(part > 0, part, shared / np.maximum(different, 1))))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *parts], [*names, "o_a", "o_b"])

    return map_batches(pairs.select(*names, "shared", "seq_a", "seq_b"), one, "t byte, id_a bigint, id_b bigint, path string, o_a double, o_b double")


def _tab(t: str) -> str:
    return f"CASE WHEN {t} = 1 THEN 'train' ELSE 'prompts' END"


def class_overlaps(rows: DataFrame, out: Written, num: int, den: int, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, pairs of classes (t, a, b, o_a, o_b, path)); a and b are (k_hi, k_lo, n, n_held). All are written."""
    shaped = out.table(shape(rows), "shaped")
    classes = out.table(classes_of(shaped), "classes")
    members = out.table(shaped.drop("seq"), "members")
    out.drop("shaped")
    tables = classes.sparkSession.sparkContext.broadcast(held_tables(classes.where("n_held > 0"), out))
    found = near.near_classes(classes, out, num, den, sides=True, hot=hot, more=chunk_family(tables), columns=("seq",))
    path = F.when(F.col("chunks") > 0, "chunks").otherwise("words").alias("path")
    links = out.table(found.select("t", "id_a", "id_b", "shared", path), "links")
    out.drop("gated")
    met = out.table(near.among(classes.select("t", "id", "seq", "k_hi", "k_lo", "n", "n_held"), links), "linked")
    a, b = (met.select("t", F.col("id").alias(f"id_{c}"), F.col("seq").alias(f"seq_{c}")) for c in "ab")
    parts = chunk_overlaps(links.join(a, ["t", "id_a"]).join(b, ["t", "id_b"]))
    a, b = (met.select("t", F.col("id").alias(f"id_{c}"), F.struct("k_hi", "k_lo", "n", "n_held").alias(c)) for c in "ab")
    return members, classes, out.table(parts.join(a, ["t", "id_a"]).join(b, ["t", "id_b"]).select("t", "a", "b", "o_a", "o_b", "path"), "class_pairs")


def overlaps(rows: DataFrame, num: int = 7, den: int = 10, hot: int = near.HOT) -> DataFrame:
    """(tab, id_a, id_b, held_a, overlap_a, overlap_b, path): pairs of a held-out and a training row that are copies or near.

    ``overlap_a`` is the part of the words of id_a that stand in chunks of id_b (of its different words that id_b has, where they share no chunk), 1 for copies, ``held_a`` whether id_a is the held-out row, and
    ``path`` which way the pair was found: 'copies', 'chunks' or 'words'. Null texts and texts without letter or digit are in no pair; all rows
    of a class of copies are paired.
    """
    out = Written(rows.sparkSession, "p5")
    members, classes, near_ = class_overlaps(rows, out, num, den, hot)
    one = F.lit(1.0)
    same = classes.where("n_held > 0 and n_held < n").select("t", F.struct("k_hi", "k_lo", "n", "n_held").alias("a"), one.alias("o_a"), one.alias("o_b"), F.lit("copies").alias("path")).withColumn("b", F.col("a"))
    either = near_.unionByName(near_.select("t", F.col("b").alias("a"), F.col("a").alias("b"), F.col("o_b").alias("o_a"), F.col("o_a").alias("o_b"), "path")).unionByName(same)
    # a: the held-out rows of one class, b: the training rows of the other.
    directed = either.where("a.n_held > 0 and b.n_held < b.n").selectExpr(
        f"{_tab('t')} AS tab", "a.k_hi AS a_hi", "a.k_lo AS a_lo", "a.n_held AS n_a", "b.k_hi AS b_hi", "b.k_lo AS b_lo", "b.n - b.n_held AS n_b", "o_a", "o_b", "path"
    )
    pairs_ = out.table(directed, "pairs")
    out.keep("members", "pairs")
    held = in_classes(members.where("held"), pairs_, "a").selectExpr("tab", "id AS x", "k_hi AS a_hi", "k_lo AS a_lo")
    kept = in_classes(members.where("not held"), pairs_, "b").selectExpr("tab", "id AS y", "k_hi AS b_hi", "k_lo AS b_lo")
    total = members.count()
    first = salt_join(held, pairs_, ["tab", "a_hi", "a_lo"], "x", "n_a", total)
    got = salt_join(kept, first, ["tab", "b_hi", "b_lo"], "y", "n_b", total, counts=pairs_)
    of_a = F.col("x") < F.col("y")
    return got.where("x <> y").select(
        "tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), of_a.alias("held_a"),
        F.when(of_a, F.col("o_a")).otherwise(F.col("o_b")).alias("overlap_a"), F.when(of_a, F.col("o_b")).otherwise(F.col("o_a")).alias("overlap_b"), "path",
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(split_rows(spark, sf_dir)).select("tab", "id_a", "id_b")


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(split_rows(spark, sf_dir))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, path, pairs): how many pairs of classes of copies each path found."""
    _, _, pairs = class_overlaps(split_rows(spark, sf_dir), Written(spark, "p5"), 7, 10, near.HOT)
    return pairs.groupBy(F.expr(_tab("t")).alias("tab"), "path").agg(F.count("*").alias("pairs"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, split, source, rows, overlapping): for each split and source of held-out rows, how many stand in the training rows."""
    prompts = read(spark, sf_dir, "prompts").where("split in ('validation', 'test')").select(F.lit("prompts").alias("tab"), F.col("prompt_id").alias("id"), "split", "source")
    val = read(spark, sf_dir, "val").select(F.lit("train").alias("tab"), F.col("sample_id").alias("id"), "split", "source")
    found = p5_overlaps(spark, sf_dir).select("tab", F.when(F.col("held_a"), F.col("id_a")).otherwise(F.col("id_b")).alias("id")).distinct().withColumn("hit", F.lit(1))
    g = prompts.unionByName(val).join(found, ["tab", "id"], "left").groupBy("tab", "split", "source")
    return g.agg(F.count("*").alias("rows"), F.count("hit").alias("overlapping"))


QUERIES = {"p5_found": p5_found, "p5_overlaps": p5_overlaps, "p5_paths": p5_paths, "p5_counts": p5_counts}
