"""Near-duplicate search over sets of words: an inverted join on signature coordinates.

The signature of a record is its set of words in one order of the whole corpus, rarest first (by a
sketch of the word counts). A coordinate is a word in that order, or a short run of chosen words where
a single one would be too common; records are posted under the values of their coordinates.

*Prefix*: two sets with Jaccard similarity s share at least ``o`` words, so they share one among the
first ``len - o + 1`` words of each, and two among the first ``len - o + 2``, and so on. In the role of
the smaller record of a pair ``o`` is 2s/(1+s) of its length, in that of the larger one s of it; the
smaller posts the short prefix ("index"), the larger the long one ("probe").
*Skip*: words that occur in one record only are not posted, and a value is posted in the long prefix
only if a record has it in a short one (a bit table, see ``BitTable``). The lists of the words behind the prefix, the longest
ones, are not merged at all.
*Split*: a value expected in more than TARGET records is not posted alone but with each next word that
could be shared, to a depth of DEPTH; the expectation is a function of the value, so both records of a
pair split alike while they share a next word. A run as long as the least number of shared words (sets of up to 4 words) is posted
unextended too, since one record may end where the other goes on. What is still too long for one task is split into blocks by record (``_blocks``).
*Count*: the collisions of a pair in the lists that were merged are summed. A pair stays only if it can reach the match threshold: each
posting carries the parities of the record's words in PARITIES cells, and two sets differ in at least as many words as their parities do in cells.
A finer gate of GATE such cells, which the records of these pairs alone carry, comes before their sets are fetched.
For the pairs that stay, the count is finished on the skipped lists, by the two sets themselves, and held against the threshold.

No pair at or above the threshold is lost: nothing above is a sample or a cap. Words are compared by
32-bit hashes, so a pair of 30-word records has a chance below 1e-6 of a word counted as shared wrongly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import forms, keys
from skein.llm.records import digest_columns, identified, map_batches
from skein.session import Written

#: Records a posted value may be expected in, words of a coordinate, rows of a value for one task.
TARGET, DEPTH, HOT = 1_500, 4, 8_000
#: Records whose values a bucket holds (some 1.5 million postings), values that a task puts together before it passes them on, postings of a bucket before hot values are taken out.
PER_BUCKET, TOGETHER, ROOM = 100_000, 1 << 19, 1 << 21
#: Words from which a record posts single words only (splitting grows with the square of the prefix).
LONG = 2_000
SKETCH_BITS, STEPS = 24, 6
#: A posting is (key, id, tag). From the top, ``key`` holds 44 bits of the value and 20 of the record's parities, ``tag`` the other 44 parities,
#: 15 of the size (larger ones count as the largest, which prunes less), 1 of the kind of the value (0 words, 1 chunks), 1 of t, and whether the value is in the short prefix (MARK), the
#: record may be the left one of a pair (LEFT), and the right one (RIGHT). So a key is sorted by value, and values that differ are 44 bits apart.
PARITIES, GATE = 64, 128
IN_KEY, SIZE_AT, SIZE_BITS, T_AT, CHUNK, MARK, LEFT, RIGHT = 20, 5, 15, 3, 16, 4, 2, 1
MOST_SIZE = (1 << SIZE_BITS) - 1


@dataclass(frozen=True)
class Sketch:
    """Counts of words, on a logarithmic scale of one byte, by the low bits of their hash; and the number of records.

    A cell holds the count of its most frequent word, so a rare word looks common only where it meets a common one: what fills
    the cells is the number of common words, not that of all words.
    """

    codes: np.ndarray
    records: int


@dataclass(frozen=True)
class BitTable:
    """Which values there are: PER_VALUE bits for each, rounded up to a power of two, but at most 2**MOST_BITS (32 MB).

    A table that is too small for its values says yes more often, which spares less and loses nothing.
    """

    bits: int
    table: np.ndarray

    PER_VALUE, LEAST_BITS, MOST_BITS = 16, 16, 28

    @classmethod
    def of(cls, values: DataFrame, expected: int) -> BitTable:
        """Built from a column ``key`` of about ``expected`` 64-bit values; the words of 64 bits that hold one come to the driver."""
        bits = cls.bits_for(expected)
        slot = f"shiftrightunsigned(key, {64 - bits})"
        got = values.groupBy(F.expr(f"cast(shiftright({slot}, 6) AS int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS INT)))").alias("bits")).toArrow()
        return cls.filled(bits, got["at"].to_numpy(), got["bits"].to_numpy())

    @classmethod
    def bits_for(cls, expected: int) -> int:
        return min(cls.MOST_BITS, max(cls.LEAST_BITS, (expected * cls.PER_VALUE).bit_length()))

    @classmethod
    def filled(cls, bits: int, at: np.ndarray, words: np.ndarray) -> BitTable:
        table = np.zeros(1 << (bits - 6), np.uint64)
        table[at] = words.view(np.uint64)
        return cls(bits, table.view(np.uint8))

    def has(self, key: np.ndarray) -> np.ndarray:
        slot = key >> np.uint64(64 - self.bits)
        return (self.table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


class WordHashes(dict):
    """32-bit hashes of words, each reckoned once a batch."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) & 0xFFFFFFFF
        return got


def shape(rows: DataFrame) -> DataFrame:
    """(tab, id, held, k_hi, k_lo, words): copy-key digest and sorted 32-bit word hashes of each text.

    Null texts, texts without letter or digit, and rows without id or tab are left out; a null ``held`` is false.
    """

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, digests, flat, ends = [], [], [], [0]
        known = WordHashes()
        for i, x in enumerate(b.column("text").to_pylist()):
            form = forms.visible_form(x)
            seq, key = keys.keys_of_form(form) if form else ("", "")
            if not key:
                continue
            keep.append(i)
            digests.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
            flat.extend(map(known.__getitem__, keys.words_of(seq)))
            ends.append(len(flat))
        hi, lo = digest_columns(digests)
        kept = pa.array(keep, pa.int32())
        sizes, hashes = np.diff(np.array(ends)), np.array(flat, np.uint32).view(np.int32)
        order = np.lexsort((hashes, np.repeat(np.arange(len(keep)), sizes)))
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[order], pa.int32()))
        return pa.RecordBatch.from_arrays([*(b.column(c).take(kept) for c in ("tab", "id", "held")), hi, lo, words], ["tab", "id", "held", "k_hi", "k_lo", "words"])

    return map_batches(identified(rows).select("tab", "id", F.coalesce("held", F.lit(False)).alias("held"), "text"), one, "tab string, id bigint, held boolean, k_hi bigint, k_lo bigint, words array<int>")


def classes_of(shaped: DataFrame) -> DataFrame:
    """One row per set of copies: (t, id, k_hi, k_lo, words, n, n_held); all copies have the same words."""
    g = shaped.groupBy("tab", "k_hi", "k_lo").agg(
        F.min("id").alias("id"), F.count("*").alias("n"), F.sum(F.col("held").cast("long")).alias("n_held"), F.min("words").alias("words")
    )
    return g.select((F.col("tab") == "train").cast("byte").alias("t"), "id", "k_hi", "k_lo", "words", "n", "n_held")


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The values from each offset to the next as one binary value: Spark copies it as a whole, an array it takes apart."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a column that ``packed`` made."""
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if not offsets[-1]:
        return np.zeros(0, kind), offsets
    first = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
    values = np.frombuffer(col.buffers()[2], np.uint8)[first : first + offsets[-1]].view(kind)
    return values, offsets // values.itemsize


def parts_for(rows: DataFrame, records: int) -> int:
    """Buckets of values of so many records: those of the session's shuffles, or more, so that a task can hold one."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), records // PER_BUCKET)


def bucket_of(high: np.ndarray, parts: int) -> np.ndarray:
    """The bucket of numbers that are spread evenly over 32 bits: a range of them."""
    return (high.astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)


def runs_of(values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def in_buckets(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with its part of each column as one binary value."""
    order = np.argsort(bucket, kind="stable")
    of = bucket[order]
    start = runs_of(of)
    offsets = np.append(start, len(of))
    return pa.RecordBatch.from_arrays([pa.array(of[start].astype(np.int32)), *(packed(v[order], offsets) for v in columns.values())], ["bucket", *columns])


def gathered(some: Iterator[tuple[np.ndarray, ...]], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The arrays one after another, put together until there are ``most`` values."""
    held, n = [], 0
    for arrays in some:
        held.append(arrays)
        n += len(arrays[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def sketch_of(classes: DataFrame) -> Sketch:
    """The word counts over all records. It has 2**SKETCH_BITS bytes, whatever the size of the corpus."""
    records = classes.count()
    parts, low = parts_for(classes, records), 32 - SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (w,) in gathered(((column_of_arrays(b, "words")[0].view(np.uint32),) for b in batches), TOGETHER):
            turned, n = np.unique(w << np.uint32(low) | w >> np.uint32(SKETCH_BITS), return_counts=True)  # the cell before the rest
            yield in_buckets(bucket_of(turned, parts), word=turned, n=n.astype(np.int32))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turned, n in gathered(((unpacked(b.column("word"), np.uint32)[0], unpacked(b.column("n"), np.int32)[0]) for b in batches), 1 << 62):
            order = np.argsort(turned)
            turned, n = turned[order], n[order].astype(np.int64)
            at = runs_of(turned)
            cell, n = turned[at] >> np.uint32(low), np.add.reduceat(n, at)
            cell, n = cell[n > 1], n[n > 1]
            at = runs_of(cell)
            code = np.minimum(255, np.round(np.log2(np.maximum.reduceat(n, at)) * STEPS)).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
            yield pa.RecordBatch.from_arrays([packed(v, np.array([0, len(v)])) for v in (cell[at], code)], ["cell", "code"])

    counts = classes.select("words").mapInArrow(count, "bucket int, word binary, n binary").repartitionById(parts, F.col("bucket"))
    got = counts.select("word", "n").mapInArrow(cells, "cell binary, code binary").toArrow()
    codes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for b in got.to_batches():
        codes[unpacked(b.column("cell"), np.uint32)[0]] = unpacked(b.column("code"), np.uint8)[0]
    return Sketch(codes, records)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source index, value) of start, start+1, ... for each source."""
    src = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return src, start[src] + np.arange(len(src)) - first[src]


def _prefix(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Words of the prefix in which a record must share one, if it shares num/den of its words."""
    return size - (size * num + den - 1) // den + 1


def coordinates(t: np.ndarray, words: np.ndarray, offsets: np.ndarray, sketch: Sketch, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, value, whether it is in the short prefix) of the coordinates of the long prefix."""
    size = np.diff(offsets)
    rec = np.repeat(np.arange(len(size)), size)
    code = sketch.codes[words & ((1 << SKETCH_BITS) - 1)]
    # One number of record, code and word (as signed), so that it can be sorted as such.
    turn = np.uint64(1 << 31)
    row = np.sort(rec.astype(np.uint64) << np.uint64(40) | code.astype(np.uint64) << np.uint64(32) | (words.view(np.uint32).astype(np.uint64) ^ turn))
    w, code = (row & np.uint64(0xFFFFFFFF)) ^ turn, (row >> np.uint64(32) & np.uint64(0xFF)).astype(np.int64)
    count = np.exp2(code / STEPS)
    at = np.arange(len(w)) - offsets[rec]
    length, inner = _prefix(size, num, den), _prefix(size, 2 * num, num + den)
    here = (at < length[rec]) & (code > 0)
    out_rec, out_key, out_in = [], [], []

    def post(which: np.ndarray, key: np.ndarray, within: np.ndarray) -> None:
        out_rec.append(rec[which])
        out_key.append(key)
        out_in.append(within)

    first = np.flatnonzero(here)
    within = at[first] < inner[rec[first]]
    key = mix(w[first], t[rec[first]].astype(np.uint64))
    long = size[rec[first]] * 10 >= 7 * LONG
    post(first[long], mix(key[long], np.full(int(long.sum()), 0x10)), within[long])
    short = size[rec[first]] < LONG
    last, key, within, expect, depth = first[short], key[short], within[short], count[first[short]], 1
    ends = offsets[1:]
    while len(last):
        r = rec[last]
        stop = np.minimum(offsets[r] + length[r] + depth, ends[r])  # one more word for each that is chosen
        done = (expect <= TARGET) | (depth == DEPTH) | (last + 1 >= stop)
        post(last[done], key[done], within[done])
        # A pair that shares no more words than the run has can't go on together: only the run itself is sure to be in both.
        least, least_in = size[r] - length[r] + 1, size[r] - inner[r] + 1
        sole = ~done & (depth >= least)
        post(last[sole], key[sole], within[sole] & (depth >= least_in[sole]))
        last, key, within, expect, stop = last[~done], key[~done], within[~done], expect[~done], stop[~done]
        src, nxt = _spans(last + 1, stop - last - 1)
        key = mix(key[src], w[nxt])
        # Words of one text go together more often than by chance, hence the factor.
        expect = np.minimum(expect[src], expect[src] * count[nxt] / max(1, sketch.records) * 3)
        within = within[src] & (at[nxt] < inner[rec[nxt]] + depth)
        last, depth = nxt, depth + 1
    return np.concatenate(out_rec), np.concatenate(out_key), np.concatenate(out_in)


def parities(words: np.ndarray, offsets: np.ndarray, cells: int = PARITIES) -> list[np.ndarray]:
    """Of each record (none is empty), for each of ``cells`` cells of words, whether it has an odd number of them, 64 cells an array."""
    cell = mix(words.view(np.uint32), np.full(1, cells, np.uint64)) % np.uint64(cells)
    bit = np.uint64(1) << (cell & np.uint64(63))
    return [np.bitwise_xor.reduceat(np.where(cell >> np.uint64(6) == i, bit, np.uint64(0)), offsets[:-1]) for i in range(cells // 64)]


def posting_columns(key: np.ndarray, rec: np.ndarray, parity: np.ndarray, size: np.ndarray, t: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, tag) of postings of the records ``rec``; ``flags`` are those of the postings."""
    low = np.uint64((1 << IN_KEY) - 1)
    tag = (parity & ~low) | (np.minimum(size, MOST_SIZE).astype(np.uint64) << np.uint64(SIZE_AT)) | (t.astype(np.uint64) << np.uint64(T_AT))
    return ((key & ~low) | (parity & low)[rec]).view(np.int64), (tag[rec] | flags).view(np.int64)


def column_of_arrays(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets from 0) of a column without nulls: arrays, or packed 32-bit numbers."""
    col = b.column(name)
    if pa.types.is_binary(col.type):
        return unpacked(col, np.int32)
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    return col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def values(classes: DataFrame, sketch: Sketch, num: int, den: int, short: bool) -> DataFrame:
    """(key, short): the values of each record and whether they are in its short prefix, with ``short`` only those."""
    shared = classes.sparkSession.sparkContext.broadcast(sketch)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        found, inside = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for lo, hi, t, part, off in _slices(b):
            _, key, within = coordinates(t[lo:hi], part, off, shared.value, num, den)
            found.append(key[within] if short else key)
            inside.append(within[within] if short else within)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(inside))], ["key", "short"])

    return map_batches(classes.select("t", "id", "words"), one, "key bigint, short boolean")


def bit_tables(rows: DataFrame, sizes: dict[tuple, int], by: list[str]) -> dict[tuple, BitTable]:
    """A table for each group of ``sizes`` (values of the columns ``by``: about how many keys) of rows (key, by), in one job.

    Large tables come to the driver one after another, so it never gets more than one of the largest at a time.
    """
    bits = {g: BitTable.bits_for(n) for g, n in sizes.items()}
    if sum(1 << n for n in bits.values()) > 1 << BitTable.MOST_BITS:
        return {g: BitTable.of(rows.where(" AND ".join(f"{c} = {v}" for c, v in zip(by, g))).select("key"), n) for g, n in sizes.items()}
    case = "CASE " + " ".join("WHEN " + " AND ".join(f"{c} = {v}" for c, v in zip(by, g)) + f" THEN {64 - n}" for g, n in bits.items()) + " END"
    slot = rows.selectExpr(*by, f"shiftrightunsigned(key, {case}) AS slot")
    got = slot.groupBy(*by, F.expr("cast(shiftright(slot, 6) AS int)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits")).toArrow()
    at, words, of = got["at"].to_numpy(), got["bits"].to_numpy(), [got[c].to_numpy() for c in by]
    out = {}
    for g, n in bits.items():
        here = np.logical_and.reduce([c == v for c, v in zip(of, g)]) if len(at) else np.zeros(0, bool)
        out[g] = BitTable.filled(n, at[here], words[here])
    return out


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first record, end, t of all, words, offsets) of parts of a batch, which bound the memory of the splits."""
    words, offsets = column_of_arrays(b, "words")
    t = b.column("t").to_numpy(zero_copy_only=False)
    for lo in range(0, len(t), 2000):
        hi = min(len(t), lo + 2000)
        if offsets[hi] > offsets[lo]:
            yield lo, hi, t, words[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


#: A family of coordinates: from a batch of classes the (record, key, tag) of its postings.
Family = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]


def word_family(shared: Broadcast, num: int, den: int, sides: bool) -> Family:
    """Postings of the records under those coordinates of their words that the first table holds; a value's record is left if it has it in its short prefix.

    With ``sides``, records with held-out rows are left and those with training rows right. Records without held-out rows then post only
    what can meet a mark: their marked values that the first table holds, and others that the second one, of marked values, holds.
    """

    def family(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sk, table, of_marks = shared.value
        flags = side_flags(b) if sides else None
        found = [(np.zeros(0, np.int64),) * 3]
        for lo, hi, t, part, off in _slices(b):
            rec, key, within = coordinates(t[lo:hi], part, off, sk, num, den)
            if flags is None:
                hit = table.has(key)
            else:
                hit = (flags[lo:hi][rec] & np.uint64(LEFT) > 0) | (table.has(key) & within) | of_marks.has(key)
            rec, key, mark = rec[hit], key[hit], within[hit].astype(np.uint64) * np.uint64(MARK)
            side = flags[lo:hi][rec] if flags is not None else within[hit].astype(np.uint64) * np.uint64(LEFT) | np.uint64(RIGHT)
            found.append((rec + lo, *posting_columns(key, rec, parities(part, off)[0], np.diff(off), t[lo:hi], mark | side)))
        return tuple(map(np.concatenate, zip(*found)))

    return family


def postings(classes: DataFrame, families: list[Family], columns: list[str], parts: int) -> DataFrame:
    """The postings of all families, made in one pass over ``columns`` of the classes, in ``parts`` buckets of values: the numbers of many postings in a row."""

    def some(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        rec, key, tag = map(np.concatenate, zip(*(family(b) for family in families)))
        return key, b.column("id").to_numpy(zero_copy_only=False)[rec], tag

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, id_, tag in gathered(map(some, batches), TOGETHER):
            yield in_buckets(bucket_of(key.view(np.uint64) >> np.uint64(32), parts), key=key, id=id_, tag=tag)

    return classes.select(*columns).mapInArrow(run, "bucket int, key binary, id binary, tag binary").repartitionById(parts, F.col("bucket")).drop("bucket")


def side_flags(b: pa.RecordBatch) -> np.ndarray:
    """LEFT for classes with held-out rows, RIGHT for those with training rows."""
    n, held = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "n_held"))
    return (held > 0) * np.uint64(LEFT) | (held < n) * np.uint64(RIGHT)


#: ``t`` with the kind of the value as its second bit.
PAIRED = "t byte, id_a bigint, id_b bigint, key bigint, id bigint, tag bigint"


def _paired(runs: DataFrame, num: int, den: int, hot: int | None = None) -> DataFrame:
    """Candidate pairs of each value. ``runs`` are the buckets of ``postings``, and the rows of a value with more than ``hot`` rows come out unpaired,
    with their value; without ``hot`` they are single postings sorted by value, which are all paired."""

    def rank(b: dict[str, np.ndarray]) -> np.ndarray:
        """Value and size: the rows of a value whose sizes suit that of a record are neighbours in this order."""
        return (b["key"].view(np.uint64) >> np.uint64(IN_KEY) << np.uint64(SIZE_BITS)) | (b["tag"].view(np.uint64) >> np.uint64(SIZE_AT) & np.uint64(MOST_SIZE))

    def pairs(b: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        tag, ranks = b["tag"].view(np.uint64), rank(b)
        marked, right = (tag & np.uint64(MARK)) > 0, (tag & np.uint64(RIGHT)) > 0
        size = (ranks & np.uint64(MOST_SIZE)).astype(np.int64)
        low = np.uint64((1 << IN_KEY) - 1)
        parity = (tag & ~low) | (b["key"].view(np.uint64) & low)
        left = np.flatnonzero(tag & np.uint64(LEFT))
        own, value = size[left], ranks[left] & ~np.uint64(MOST_SIZE)
        start = np.searchsorted(ranks, value | ((own * num + den - 1) // den).astype(np.uint64))
        count = np.searchsorted(ranks, value | np.minimum(own * den // num, MOST_SIZE).astype(np.uint64), "right") - start
        cut = np.cumsum(count)
        at = 0
        while at < len(left):  # some pairs at a time, which stay in the processor's cache
            to = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + 200_000, "right")))
            src, y = _spans(start[at:to], count[at:to])
            x = left[at:to][src]
            sx, sy = size[x], size[y]
            ok = right[y] & ((marked[x] & (sx <= sy)) | (marked[y] & (sy <= sx)))
            # |a ^ b| <= (1-s)/(1+s) * (|a| + |b|), and at least as many words differ as parities do.
            ok &= np.bitwise_count(parity[x] ^ parity[y]) <= most[np.minimum(sx + sy, len(most) - 1)]
            x, y = x[ok], y[ok]
            ok = b["id"][x] != b["id"][y]
            yield x[ok], y[ok]
            at = to

    # The words of two sets that may differ, by the sum of their sizes; all cells may where the sum is larger.
    most = np.minimum(np.arange(PARITIES * (den + num) // max(1, den - num) + 2) * (den - num) // (den + num), PARITIES).astype(np.uint8)

    names = ["key", "id", "tag"]

    def loose(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(b["id"]), 50_000):
            some = taken(b, slice(lo, lo + 50_000))
            none = pa.nulls(len(some["id"]), pa.int64())
            t = pa.array(((some["tag"] >> T_AT) & 3).astype(np.int8))
            yield pa.RecordBatch.from_arrays([t, none, none, *(pa.array(some[c]) for c in names)], ["t", "id_a", "id_b", *names])

    def tight(b: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The pairs of rows that are sorted by ``rank``."""
        each = ((b["id"][x], b["id"][y], (b["tag"][x] >> T_AT) & 3) for x, y in pairs(b))
        for i, j, t in gathered(each, TOGETHER):
            i, j = np.minimum(i, j), np.maximum(i, j)
            order = np.lexsort((t, j, i))
            i, j, t = i[order], j[order], t[order]
            new = np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (t[1:] != t[:-1])])
            n = int(new.sum())
            yield pa.RecordBatch.from_arrays([pa.array(t[new].astype(np.int8)), pa.array(i[new]), pa.array(j[new]), *(pa.nulls(n, pa.int64()) for _ in names)], ["t", "id_a", "id_b", *names])

    def together(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {c: np.concatenate([p[c] for p in parts]) for c in names}

    def taken(b: dict[str, np.ndarray], which: np.ndarray | slice) -> dict[str, np.ndarray]:
        return {c: v[which] for c, v in b.items()}

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        n, room, large = 0, ROOM, np.zeros(0, np.int64)  # values known to be hot

        def sifted() -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
            """The rows that are held, sorted: those of hot values, and the others."""
            nonlocal large
            b = together(held)
            b = taken(b, np.argsort(rank(b)))
            value = b["key"] >> IN_KEY
            start = runs_of(value)
            count = np.diff(np.append(start, len(value)))
            often = (count > hot) | np.isin(value[start], large)
            large = np.union1d(large, value[start[often]])
            which = np.repeat(often, count)
            return taken(b, which), taken(b, ~which)

        for batch in batches:
            held.append({c: unpacked(batch.column(c), np.int64)[0] for c in names})
            n += len(held[-1]["key"])
            if n > room:
                out, rest = sifted()
                yield from loose(out)
                held, n = [rest], len(rest["key"])
                room = max(ROOM, 2 * n)
        if n:
            out, rest = sifted()
            yield from loose(out)
            yield from tight(rest)

    def row_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # rows of the last value, which may go on in the next batch
        for batch in batches:
            b = together([*held, {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}])
            if not len(b["key"]):
                continue
            cut = int(np.searchsorted(b["key"] >> IN_KEY == b["key"][-1] >> IN_KEY, True))
            yield from tight(taken(b, np.argsort(rank(taken(b, slice(cut))))))
            held = [taken(b, slice(cut, None))]
        for h in held:
            yield from tight(taken(h, np.argsort(rank(h))))

    return runs.mapInArrow(row_by_row if hot is None else bucket, PAIRED)


def _sorted_runs(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.shiftright("key", IN_KEY)).sortWithinPartitions("key")


def _blocks(loose: DataFrame, hot: int) -> DataFrame:
    """Rows of hot values again, each value split into blocks of left rows x blocks of right rows.

    A left row is copied as such to the blocks of its row, a right row to those of its column.
    """
    left, right = F.col("tag").bitwiseAND(LEFT) > 0, F.col("tag").bitwiseAND(RIGHT) > 0
    rows = loose.select(F.shiftright("key", IN_KEY).alias("value"), F.col("key").bitwiseAND((1 << IN_KEY) - 1).alias("low"), "id", "tag")
    of = rows.groupBy("value").agg(*(F.ceil(F.count(F.when(c, 1)) / (hot // 4)).cast("int").alias(n) for c, n in ((left, "bi"), (right, "bp"))))
    rows = rows.join(of, "value").where("bi > 0 and bp > 0")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    across = rows.where(left).select("value", "low", "id", F.expr(f"tag & ~{RIGHT}L").alias("tag"), own("bi").alias("i"), F.explode(F.sequence(F.lit(0), F.col("bp") - 1)).alias("p"))
    down = rows.where(right).select("value", "low", "id", F.expr(f"tag & ~{LEFT}L").alias("tag"), F.explode(F.sequence(F.lit(0), F.col("bi") - 1)).alias("i"), own("bp").alias("p"))
    key = F.xxhash64("value", "i", "p").bitwiseAND(-1 << IN_KEY).bitwiseOR(F.col("low"))
    return across.unionByName(down).select(key.alias("key"), "id", "tag")


def collide(posts: DataFrame, out: Written, num: int, den: int, hot: int = HOT) -> DataFrame:
    """(t, id_a, id_b, collisions, chunks): the pairs that share a value and can still reach the threshold, and how many values are chunks; written as "candidates".

    ``posts`` are ``postings`` in buckets.
    """
    found = out.table(_paired(posts, num, den, hot), "paired")
    again = _paired(_sorted_runs(_blocks(found.where("key is not null").select("key", "id", "tag"), hot)), num, den)
    met = found.where("id_a is not null").select("t", "id_a", "id_b").unionByName(again.select("t", "id_a", "id_b"))
    met = met.groupBy(F.col("t").bitwiseAND(1).cast("byte").alias("t"), "id_a", "id_b").agg(F.count("*").alias("collisions"), F.count_if(F.col("t") > 1).alias("chunks"))
    got = out.table(met, "candidates")
    out.drop("paired")
    return got


#: Ids that may be broadcast as they are (some 12 MB).
MOST_IDS = 500_000


def among(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The classes that are in a pair (t, id_a, id_b), and a few more, without a shuffle of the others.

    Up to MOST_IDS ids are broadcast; of more, a bit table is, in which some others are found too.
    """
    ids = pairs.select("t", F.explode(F.array("id_a", "id_b")).alias("id")).select(F.xxhash64("t", "id").alias("key"))
    each = ids.distinct()
    if each.count() <= MOST_IDS:
        return classes.join(F.broadcast(each), F.xxhash64("t", "id") == F.col("key"), "left_semi")
    table = classes.sparkSession.sparkContext.broadcast(BitTable.of(ids, 2 * pairs.count()))
    wide = classes.select(F.xxhash64("t", "id").alias("slot"), *classes.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(table.value.has(b.column("slot").to_numpy(zero_copy_only=False).view(np.uint64))))

    return wide.mapInArrow(run, wide.schema).drop("slot")


def _with_gates(classes: DataFrame) -> DataFrame:
    """(t, id, n, n_held, size, g_0, g_1 ...): the number of words of each class and their parities in GATE cells."""
    gates = [f"g_{i}" for i in range(GATE // 64)]

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        words, offsets = column_of_arrays(b, "words")
        got = parities(words, offsets, GATE) if b.num_rows else [np.zeros(0, np.uint64)] * len(gates)
        arrays = [*(b.column(c) for c in ("t", "id", "n", "n_held")), pa.array(np.diff(offsets)), *(pa.array(g.view(np.int64)) for g in got)]
        return pa.RecordBatch.from_arrays(arrays, ["t", "id", "n", "n_held", "size", *gates])

    return map_batches(classes.select("t", "id", "n", "n_held", "words"), one, "t byte, id bigint, n bigint, n_held bigint, size bigint, " + ", ".join(f"{g} bigint" for g in gates))


def gate(classes: DataFrame, candidates: DataFrame, out: Written, num: int, den: int, sides: bool) -> DataFrame:
    """The candidates that can still reach the threshold by their parities in GATE cells, with ``sides`` those of a held-out and a training row; written as "gated"."""
    gated = out.table(_with_gates(among(classes.select("t", "id", "n", "n_held", "words"), candidates)), "gates")
    gates = gated.columns[5:]
    a, b = (gated.select("t", F.col("id").alias(f"id_{c}"), F.struct(*gated.columns[2:]).alias(c)) for c in "ab")
    differ = sum((F.bit_count(F.col(f"a.{g}").bitwiseXOR(F.col(f"b.{g}"))) for g in gates), F.lit(0))
    both = candidates.join(a, ["t", "id_a"]).join(b, ["t", "id_b"]).where(differ * (den + num) <= (den - num) * (F.col("a.size") + F.col("b.size")))
    if sides:
        both = both.where("(a.n_held > 0 and b.n_held < b.n) or (b.n_held > 0 and a.n_held < a.n)")
    left = out.table(both.select(*candidates.columns), "gated")
    out.drop("gates")
    return left


def counted(classes: DataFrame, pairs: DataFrame, out: Written, num: int, den: int) -> DataFrame:
    """The pairs whose sets share enough words, with ``shared``."""
    met = out.table(among(classes.select("t", "id", "words"), pairs), "candidate_words")
    a, b = (met.select("t", F.col("id").alias(f"id_{c}"), F.col("words").alias(f"w_{c}")) for c in "ab")
    names = pairs.columns
    both = pairs.join(a, ["t", "id_a"]).join(b, ["t", "id_b"]).select(*names, "w_a", "w_b")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [column_of_arrays(batch, c) for c in ("w_a", "w_b")]
        sizes = [np.diff(offsets) for _, offsets in sets]
        each = [np.repeat(np.arange(len(n)), n).astype(np.uint64) << np.uint64(32) | words.view(np.uint32) for (words, _), n in zip(sets, sizes)]
        shared = np.bincount((np.intersect1d(*each, assume_unique=True) >> np.uint64(32)).astype(np.int64), minlength=batch.num_rows).astype(np.int32)
        keep = pa.array(shared.astype(np.int64) * (num + den) >= num * (sizes[0] + sizes[1]))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared)], [*names, "shared"]).filter(keep)

    return map_batches(both, one, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes) + ", shared int")


def word_tables(classes: DataFrame, num: int, den: int, sides: bool) -> tuple[Sketch, BitTable, BitTable | None]:
    """The sketch, the values that are posted, and with ``sides`` those that held-out records have in their short prefixes."""
    sketch = sketch_of(classes)
    if not sides:
        return sketch, BitTable.of(values(classes, sketch, num, den, True), 2 * sketch.records), None
    held = classes.where("n_held > 0")
    n, all_ = held.count(), values(held, sketch, num, den, False)
    both = all_.withColumn("short", F.explode(F.when(F.col("short"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    tables = bit_tables(both, {(False,): 8 * n, (True,): 2 * n}, ["short"])
    return sketch, tables[False,], tables[True,]


def near_classes(classes: DataFrame, out: Written, num: int = 7, den: int = 10, sides: bool = False, hot: int = HOT, more: Family | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """(t, id_a, id_b, shared, collisions, chunks): pairs of records with similarity of at least num/den.

    ``classes`` is (t, id, words, n, n_held, ...), ids unique within t; it is read several times and should be a
    written table. With ``sides``, only pairs of a record with held-out rows and one with training rows. The postings of another family, ``more``, made
    from ``columns`` too, are joined with those of the words.
    """
    tables = word_tables(classes, num, den, sides)
    shared = classes.sparkSession.sparkContext.broadcast(tables)
    families = [word_family(shared, num, den, sides), *([more] if more else [])]
    candidates = collide(postings(classes, families, ["t", "id", "words", "n", "n_held", *columns], parts_for(classes, tables[0].records)), out, num, den, hot)
    left = gate(classes, candidates, out, num, den, sides)
    out.drop("candidates")
    return counted(classes, left, out, num, den)
