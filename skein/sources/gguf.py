"""GGUF tensor files: metadata of typed values, tensors as f32, f16, bf16 or q8_0 blocks. Headers are read alone; data by byte range, a task a file."""

from __future__ import annotations

import io
import os
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from skein.sources.readers import from_bf16, to_bf16

# Fixed values of the format: magic, version, alignment, codes of value types and of tensor types.
MAGIC, VERSION, ALIGN = b"GGUF", 3, 32
SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
TENSORS = {"f32": 0, "f16": 1, "q8_0": 8, "bf16": 30}
BLOCK = 32

_names = {v: k for k, v in TENSORS.items()}


def quantised(values: np.ndarray) -> bytes:
    """q8_0: blocks of 32 values as a half-precision scale and 32 signed bytes. The last axis must be whole blocks."""
    if values.shape[-1] % BLOCK:
        raise ValueError(f"rows of {values.shape[-1]} values are no whole blocks")
    x = values.astype(np.float32).reshape(-1, BLOCK)
    scale = np.abs(x).max(axis=1) / 127
    inverse = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    out = np.zeros(len(x), np.dtype([("d", "<f2"), ("q", "i1", BLOCK)]))
    out["d"], out["q"] = scale, np.round(x * inverse[:, None])
    return out.tobytes()


def unquantised(raw: bytes) -> np.ndarray:
    got = np.frombuffer(raw, np.dtype([("d", "<f2"), ("q", "i1", BLOCK)]))
    return (got["d"].astype(np.float32)[:, None] * got["q"]).reshape(-1)


def n_bytes(shape: list[int], kind: str) -> int:
    n = int(np.prod(shape, dtype=np.int64))
    return n // BLOCK * (BLOCK + 2) if kind == "q8_0" else n * {"f32": 4, "f16": 2, "bf16": 2}[kind]


def _encoded(values: np.ndarray, kind: str) -> bytes:
    if kind == "q8_0":
        return quantised(values)
    return np.ascontiguousarray(to_bf16(values) if kind == "bf16" else values.astype({"f32": "<f4", "f16": "<f2"}[kind])).tobytes()


def _decoded(raw: bytes, kind: str) -> np.ndarray:
    if kind == "q8_0":
        return unquantised(raw)
    return from_bf16(np.frombuffer(raw, "<u2")) if kind == "bf16" else np.frombuffer(raw, {"f32": "<f4", "f16": "<f2"}[kind]).astype(np.float32)


def _string(s: str) -> bytes:
    b = s.encode()
    return struct.pack("<Q", len(b)) + b


def _value(v: object) -> bytes:
    """A value with its type: whole numbers as i64 (u32 where they fit), others by their Python type; a list by its first value."""
    if isinstance(v, bool):
        return struct.pack("<I?", 7, v)
    if isinstance(v, int):
        return struct.pack("<II", 4, v) if 0 <= v < 1 << 32 else struct.pack("<Iq", 11, v)
    if isinstance(v, float):
        return struct.pack("<If", 6, v)
    if isinstance(v, str):
        return struct.pack("<I", STRING) + _string(v)
    each = [_value(x) for x in v]
    if len({x[:4] for x in each}) > 1:
        raise ValueError("the values of a list have several types")
    return struct.pack("<I", ARRAY) + (each[0][:4] if each else struct.pack("<I", STRING)) + struct.pack("<Q", len(each)) + b"".join(x[4:] for x in each)


def write(tensors: dict[str, np.ndarray], metadata: dict[str, object], path: Path | str, kinds: dict[str, str] | None = None) -> int:
    """Writes the tensors in their order, checks the file by its header and puts it in the place of the target; the number of tensors."""
    kinds = {k: (kinds or {}).get(k, "f32") for k in tensors}
    head = io.BytesIO()
    head.write(MAGIC + struct.pack("<IQQ", VERSION, len(tensors), len(metadata)))
    for k, v in metadata.items():
        head.write(_string(k) + _value(v))
    at = 0
    for name, x in tensors.items():
        head.write(_string(name) + struct.pack(f"<I{x.ndim}QIQ", x.ndim, *x.shape[::-1], TENSORS[kinds[name]], at))
        at += -(-n_bytes(list(x.shape), kinds[name]) // ALIGN) * ALIGN
    path = Path(path)
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    with part.open("wb") as f:
        f.write(head.getvalue())
        f.write(bytes(-f.tell() % ALIGN))
        for name, x in tensors.items():
            f.write(_encoded(x, kinds[name]))
            f.write(bytes(-f.tell() % ALIGN))
    back = header(part)[1]
    if {k: (v["shape"], v["kind"]) for k, v in back.items()} != {k: (list(x.shape), kinds[k]) for k, x in tensors.items()}:
        part.unlink()
        raise OSError(f"{path} didn't read back as written")
    os.replace(part, path)
    return len(back)


def header(path: Path | str) -> tuple[dict[str, object], dict[str, dict]]:
    """(metadata, tensors: name to shape, kind, begin, end in bytes); no tensor is read."""
    with open(path, "rb") as f:
        take = lambda form: struct.unpack(form, f.read(struct.calcsize(form)))
        text = lambda: f.read(take("<Q")[0]).decode()

        def value(kind: int) -> object:
            if kind == STRING:
                return text()
            if kind == ARRAY:
                of, n = take("<IQ")
                return [value(of) for _ in range(n)]
            return take(SCALARS[kind])[0]

        if f.read(4) != MAGIC:
            raise ValueError(f"{path} is no GGUF file")
        version, n_tensors, n_values = take("<IQQ")
        if version != VERSION:
            raise ValueError(f"{path} has version {version}")
        metadata = {text(): value(take("<I")[0]) for _ in range(n_values)}
        found = []
        for _ in range(n_tensors):
            name, (n,) = text(), take("<I")
            shape = list(take(f"<{n}Q"))[::-1]
            kind, offset = take("<IQ")
            found.append((name, shape, _names.get(kind, f"type {kind}"), offset))
        base = -(-f.tell() // ALIGN) * ALIGN
    return metadata, {name: {"shape": s, "kind": k, "begin": base + at, "end": base + at + (n_bytes(s, k) if k in TENSORS else 0)} for name, s, k, at in found}


def tensors(spark: SparkSession, paths: list[str], wanted: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """(path, name, kind, shape, data ARRAY<FLOAT>) of the wanted tensors; a task a file, and only their byte ranges are read. Every executor must see the paths."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with open(path, "rb") as f:
                    for name, t in header(path)[1].items():
                        if wanted(name):
                            f.seek(t["begin"])
                            yield pd.DataFrame({"path": [path], "name": [name], "kind": [t["kind"]], "shape": [t["shape"]], "data": [_decoded(f.read(t["end"] - t["begin"]), t["kind"])]})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(read, "path string, name string, kind string, shape array<int>, data array<float>")


def recast(source: Path | str, target: Path | str, kind_of: Callable[[str, list[int]], str], wanted: Callable[[str], bool] = lambda _: True) -> int:
    """A companion file: the wanted tensors of ``source`` in the types that ``kind_of`` (name, shape) says, with the same metadata."""
    metadata, found = header(source)
    values, kinds = {}, {}
    with open(source, "rb") as f:
        for name, t in found.items():
            if wanted(name):
                f.seek(t["begin"])
                values[name] = _decoded(f.read(t["end"] - t["begin"]), t["kind"]).reshape(t["shape"])
                kinds[name] = kind_of(name, t["shape"])
    return write(values, metadata, target, kinds)
