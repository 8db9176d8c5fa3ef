"""The slot for encoder models: Arrow batches in, arrays out, the model made once for each worker. The models that
come with the library are deterministic mocks with the shapes of real ones."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Model = Callable[[list[str]], list[np.ndarray]]


def mock_rows(dim: int = 16, queries: int = 4, seed: int = 7) -> Model:
    """A fixed number of rows for each text: a random projection of its byte counts."""
    basis = np.random.default_rng(seed).standard_normal((queries, 64, dim)).astype(np.float32)

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            counts = np.bincount(np.frombuffer(t.encode(), np.uint8) % 64, minlength=64).astype(np.float32)
            out.append(np.tanh(counts / max(1.0, counts.sum()) @ basis))
        return out

    return run


def mock_tokens(dim: int = 16, vocabulary: int = 32_000, window: int = 32, seed: int = 7) -> Model:
    """A row for each word, from the word's checksum and its place; the empty text has one row."""

    def run(texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            ids = word_ids(t, vocabulary, window)
            phase = np.array(ids)[:, None] * np.linspace(0.1, 1.0, dim)[None] + np.arange(len(ids))[:, None] * 0.01 + seed
            out.append(np.sin(phase).astype(np.float32))
        return out

    return run


def word_ids(text: str, vocabulary: int = 32_000, window: int = 32) -> list[int]:
    """Ids of a text's words by checksum, at most ``window`` with the end mark 1."""
    return [2 + zlib.crc32(w.encode()) % (vocabulary - 2) for w in text.split()][: window - 1] + [1]


def mock_seeded(dim: int = 16, seed: int = 7) -> Callable[[list[list[int]]], list[np.ndarray]]:
    """A model that starts from token ids: a row an id, which depends on the ids before it too."""

    def run(ids: list[list[int]]) -> list[np.ndarray]:
        ladder = np.linspace(0.1, 1.0, dim)
        return [np.sin((np.cumsum(x)[:, None] % 997 + seed) * ladder[None]).astype(np.float32) for x in ids]

    return run


#: Slots of an image in a sequence.
IMAGE_SLOTS = 5


def mock_aligned(dim: int = 16, seed: int = 7) -> Callable[[list[str], list[int]], list[dict]]:
    """A model with a row for each position of text and images: ids (0 in image slots), rows, image rows, and the segments of the images.

    Images come first, each in IMAGE_SLOTS slots with a mark between.
    """
    model = mock_seeded(dim, seed)

    def run(texts: list[str], images: list[int]) -> list[dict]:
        ids, starts = [], []
        for t, n in zip(texts, images):
            seq, at = [], []
            for _ in range(n):
                seq.append(3)
                at.append(len(seq))
                seq.extend([0] * IMAGE_SLOTS)
            ids.append(seq + word_ids(t))
            starts.append(at)
        rows = model(ids)
        return [{"ids": i, "t": r, "starts": s, "lens": [IMAGE_SLOTS] * len(s), "v": -r[[p + k for p in s for k in range(IMAGE_SLOTS)]]} for i, r, s in zip(ids, rows, starts)]

    return run


def encode_seeded(rows: DataFrame, make: Callable = mock_seeded, key: str = "sample_id", text: str = "text", batch: int = 256) -> DataFrame:
    """(key, text, ids, t): the ids of each text and a row for each of them; null is the empty text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            for at in range(0, len(p), batch):
                q = p.iloc[at : at + batch]
                texts = [t or "" for t in q[text]]
                ids = list(map(word_ids, texts))
                yield pd.DataFrame({key: q[key].to_numpy(), "text": texts, "ids": ids, "t": [x.tolist() for x in model(ids)]})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, text string, ids array<int>, t array<array<float>>")


def encode_aligned(rows: DataFrame, make: Callable = mock_aligned, key: str = "sample_id", text: str = "text", images: str = "n_images", batch: int = 256) -> DataFrame:
    """(key, text, ids, t, v, starts, lens) by a model over texts and their number of images; nulls are the empty text and no image."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            for at in range(0, len(p), batch):
                q = p.iloc[at : at + batch]
                texts = [t or "" for t in q[text]]
                got = model(texts, [int(n) if n == n and n is not None else 0 for n in q[images]])
                out = {key: q[key].to_numpy(), "text": texts}
                yield pd.DataFrame(out | {c: [x[c].tolist() if isinstance(x[c], np.ndarray) else x[c] for x in got] for c in ("ids", "t", "v", "starts", "lens")})

    kind = f"{key} {dict(rows.dtypes)[key]}, text string, ids array<int>, t array<array<float>>, v array<array<float>>, starts array<int>, lens array<int>"
    return rows.select(key, text, images).mapInPandas(run, kind)


def encode(rows: DataFrame, make: Callable[[], Model], key: str = "sample_id", text: str = "text", batch: int = 256) -> DataFrame:
    """(key, len, rows ARRAY<ARRAY<FLOAT>>): ``make`` is called once in each task, and the model on at most ``batch`` texts; null is the empty text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for p in parts:
            for at in range(0, len(p), batch):
                q = p.iloc[at : at + batch]
                got = model([t or "" for t in q[text]])
                yield pd.DataFrame({key: q[key].to_numpy(), "len": [len(x) for x in got], "rows": [x.tolist() for x in got]})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, len int, rows array<array<float>>")


def decode_image(content: bytes) -> np.ndarray | None:
    """RGB in 0..1 if an image library is installed, else None."""
    try:
        import io

        from PIL import Image
    except ImportError:
        return None
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"), np.float32) / 255.0


def image_size(content: bytes) -> tuple[int, int] | None:
    """(width, height) from the header of a PNG or JPEG, no pixels; None for other bytes."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                return None
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if kind in (0xC0, 0xC1, 0xC2):
                return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
            at += 2 + size
    return None


def crop_and_normalise(image: np.ndarray, size: int, mean: float = 0.5, deviation: float = 0.5) -> np.ndarray:
    """The shorter side scaled to ``size`` by nearest places, the centre cut out, clamped and normalised."""
    h, w = image.shape[:2]
    scale = size / min(h, w)
    nh, nw = max(size, round(h * scale)), max(size, round(w * scale))
    image = image[(np.arange(nh) * h // nh)[:, None], (np.arange(nw) * w // nw)[None]]
    y, x = (nh - size) // 2, (nw - size) // 2
    return (np.clip(image[y : y + size, x : x + size], 0.0, 1.0) - mean) / deviation


def over_white(rgba: np.ndarray) -> np.ndarray:
    """RGBA over a white ground, as 2x - 1."""
    alpha = rgba[..., 3:]
    return 2.0 * (rgba[..., :3] * alpha + 1.0 - alpha) - 1.0


def patches(image: np.ndarray, cell: int) -> np.ndarray:
    """[H, W, C] as one row for each cell, row by row."""
    h, w, c = image.shape
    cut = image[: h // cell * cell, : w // cell * cell].reshape(h // cell, cell, w // cell, cell, c)
    return cut.transpose(0, 2, 1, 3, 4).reshape(-1, cell * cell * c)


def cell_means(image: np.ndarray, cell: int) -> np.ndarray:
    return patches(image, cell).reshape(-1, cell * cell, image.shape[2]).mean(axis=1)
