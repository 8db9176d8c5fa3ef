"""Problem 7: token ids of all documents by a public byte-level BPE, by tree concatenation.

A text is halved until no part is longer than ``PIECE`` characters; the parts of a text are encoded side by side, wherever they were cut, and
joined as a tree: around each join a window of tokens is encoded again, and grows until its first tokens are the left side's and its last ones the
right side's. Since a BPE sequence is right if and only if each two neighbours in it are, it then equals the encoding of the whole. The encoder
never sees more than a part or a window at once, whose cost may grow faster than their length. A text and its ids are one row, so they stay in one task.

Null and empty texts have the empty list. Strings that look like special tokens are plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.records import read

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary cuts text before it merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a part at most; tokens of the first window, and how many of them must agree on each side; threads for the parts of a text.
PIECE, WINDOW, AGREE, THREADS = 1_000, 32, 8, 2

_loaded: dict[str, object] = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The encoder, loaded once for each process."""
    import tiktoken

    path = str(Path(folder) / vocabulary)
    if path not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _loaded[path] = tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def join(enc, left: list[int], right: list[int], window: int = WINDOW, agree: int = AGREE) -> list[int]:
    """The ids of the concatenation of two encoded texts."""
    a, again, b, _ = seam(enc, left, right, window, agree)
    return [*left[:a], *again, *right[b:]]


def seam(enc, left, right, window: int = WINDOW, agree: int = AGREE) -> tuple[int, list[int], int, int]:
    """(tokens that stay of the left side, new ones, where the right side goes on, tokens of the last window)."""
    while True:
        a, b = min(window, len(left)), min(window, len(right))
        head, tail = list(left[len(left) - a :]), list(right[:b])
        whole = a == len(left) and b == len(right)
        try:
            again = enc.encode_ordinary(enc.decode_bytes(head + tail).decode())
        except UnicodeDecodeError:  # the window cuts a character
            if whole:
                raise
            window *= 2
            continue
        same_head = a == len(left) or (len(again) > agree and again[:agree] == head[:agree])
        same_tail = b == len(right) or (len(again) > agree and again[-agree:] == tail[-agree:])
        if whole or (same_head and same_tail):
            return len(left) - a, again, b, a + b
        window *= 2


def concatenate(enc, parts: list) -> list[int]:
    """The tree: neighbours are joined until one sequence is left."""
    return [int(x) for x in joined(enc, parts)[0]]


def joined(enc, parts: list) -> tuple[np.ndarray, int, int]:
    """(ids, joins, tokens of the widest window) of the tree over encoded parts."""
    level, joins, widest = [np.asarray(x, np.int32) for x in parts], 0, 0
    while len(level) > 1:
        up = []
        for i in range(0, len(level) - 1, 2):
            a, again, b, wide = seam(enc, left := level[i], right := level[i + 1])
            up.append(np.concatenate([left[:a], np.array(again, np.int32), right[b:]]))
            joins, widest = joins + 1, max(widest, wide)
        level = up + level[len(level) - len(level) % 2 :]
    return level[0] if level else np.zeros(0, np.int32), joins, widest


def halved(text: str, piece: int = PIECE) -> list[str]:
    """The text in equal parts, a power of two of them, of at most ``piece`` characters."""
    n = 1 << max(0, -(-len(text) // piece) - 1).bit_length()
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


def encoded(enc, text: str | None, piece: int = PIECE) -> tuple[np.ndarray, int, int]:
    """(ids, joins, tokens of the widest window) of a text."""
    if not text:
        return np.zeros(0, np.int32), 0, 0
    if len(text) <= piece:
        return np.array(enc.encode_ordinary(text), np.int32), 0, 0
    parts = halved(text, piece)
    return joined(enc, enc.encode_ordinary_batch(parts, num_threads=THREADS) if len(parts) > 16 else [enc.encode_ordinary(x) for x in parts])


def _encoded(docs: DataFrame, id_col: str, text_col: str, folder: str, piece: int) -> DataFrame:
    """(i, ids, joins, widest) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        for b in batches:
            got = [encoded(enc, x, piece) for x in b.column("x").to_pylist()]
            ends = np.cumsum([0, *(len(ids) for ids, *_ in got)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *(x for x, *_ in got)])))
            yield pa.RecordBatch.from_arrays([b.column("i"), ids, *(pa.array([x[k] for x in got], pa.int32()) for k in (1, 2))], ["i", "ids", "joins", "widest"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("x"))
    return rows.mapInArrow(run, "i bigint, ids array<int>, joins int, widest int")


def token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, piece: int = PIECE) -> DataFrame:
    """(id_col BIGINT, ids ARRAY<INT>), a row for each row of ``docs``, repeated ids included; other columns are not looked at."""
    return _encoded(docs, id_col, text_col, folder, piece).select(F.col("i").alias(id_col), "ids")


def token_joins(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, piece: int = PIECE) -> DataFrame:
    """(id_col, n_tokens, joins, widest): tokens of each text, joins of its tree, and tokens of the widest window that a join took."""
    return _encoded(docs, id_col, text_col, folder, piece).select(F.col("i").alias(id_col), F.size("ids").alias("n_tokens"), "joins", "widest")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(read(spark, sf_dir, "documents"))


def p7_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_joins(read(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids, "p7_joins": p7_joins}
