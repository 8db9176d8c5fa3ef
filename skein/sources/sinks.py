"""Sinks. Spark's committer makes a folder whole or absent; small files are replaced atomically."""

from __future__ import annotations

import json
import os
import struct
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import shared_folder
from skein.sources.readers import tensor_header, to_bf16


def _fresh(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/skein/{name}-{uuid.uuid4().hex[:12]}"


def write_lines(df: DataFrame, column: str, name: str) -> str:
    """A line a row; a line break within a row becomes a blank, a null row an empty line."""
    path = _fresh(df, name)
    df.select(F.coalesce(F.regexp_replace(column, "\n", " "), F.lit("")).alias("value")).write.text(path)
    return path


def write_records(df: DataFrame, name: str) -> str:
    path = _fresh(df, name) + ".jsonl"
    df.write.option("ignoreNullFields", False).json(path)
    return path


def write_csv(df: DataFrame, name: str) -> str:
    path = _fresh(df, name)
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "\\N").csv(path)
    return path


#: Shards of one folder.
SHARDS_A_FOLDER = 1_024


def write_shards(df: DataFrame, path: str, contract: str, a_folder: int = SHARDS_A_FOLDER) -> None:
    """Folders (split, block) of ``a_folder`` shards each, sorted by shard. Only the folders of this write are replaced, so it must hold all shards of
    each; the contract marks the whole."""
    rows = df.withColumn("block", F.floor(F.col("shard") / a_folder).cast("int")).repartition("split", "shard").sortWithinPartitions("split", "block", "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "block").parquet(path)
    mark(path, contract)


def _shared(path: str) -> tuple:
    """(JVM, file system, path) by Hadoop's API, so that a folder may be on any file system that Spark reads."""
    sc = SparkSession.active().sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return sc._jvm, at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def write_shared(path: str, data: bytes) -> None:
    """A small file, written beside and renamed, so it is whole or absent."""
    jvm, fs, at = _shared(path)
    part = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"{path} can't be written")


def read_shared(path: str) -> bytes | None:
    """The bytes of a small file, or None if it isn't there."""
    jvm, fs, at = _shared(path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def remove_shared(path: str) -> None:
    _, fs, at = _shared(path)
    fs.delete(at, False)


def mark(path: str, contract: str) -> None:
    """The contract in the folder's ``_contract``."""
    write_shared(f"{path}/_contract", contract.encode())


def is_current(path: str, contract: str) -> bool:
    """Whether the folder was written under this contract; another one invalidates all of it."""
    return read_shared(f"{path}/_contract") == contract.encode()


def write_atomic(path: Path | str, data: str) -> None:
    path = Path(path)
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    with part.open("w") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def write_json(path: Path | str, value: object) -> None:
    write_atomic(path, json.dumps(value, sort_keys=True, indent=1, ensure_ascii=False))


def read_json(path: Path | str, default: object = None) -> object:
    """The value, or the default for a missing or torn file."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def tensor_dtype(name: Column, shape: Column, quantise: bool = False) -> Column:
    """The type a tensor is exported as: five axes bf16, one axis or a norm f32, rows of whole blocks q8_0 on request, else f16."""
    return (
        F.when(F.size(shape) == 5, "bf16").when((F.size(shape) <= 1) | name.contains("norm"), "f32")
        .when(F.lit(quantise) & (F.element_at(shape, -1) % 32 == 0), "q8_0").otherwise("f16")
    )


def write_tensors(tensors: dict[str, np.ndarray], path: Path | str, kinds: dict[str, str] | None = None) -> int:
    """A safetensors file of f32, f16 or bf16 tensors by sorted name, read back and compared before it replaces the target."""
    header, blobs, at = {}, [], 0
    for name in sorted(tensors):
        kind = (kinds or {}).get(name, "f32")
        raw = to_bf16(tensors[name]) if kind == "bf16" else tensors[name].astype(np.float16 if kind == "f16" else np.float32)
        data = np.ascontiguousarray(raw).tobytes()
        header[name] = {"dtype": {"f32": "F32", "f16": "F16", "bf16": "BF16"}[kind], "shape": list(tensors[name].shape), "data_offsets": [at, at + len(data)]}
        blobs.append(data)
        at += len(data)
    head = json.dumps(header).encode()
    path = Path(path)
    part = path.with_name(path.name + ".part")
    with part.open("wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(blobs))
    back = tensor_header(str(part))
    if {k: v["shape"] for k, v in back.items()} != {k: list(v.shape) for k, v in tensors.items()} or part.stat().st_size != 8 + len(head) + at:
        part.unlink()
        raise OSError(f"{path} didn't read back as written")
    os.replace(part, path)
    return len(back)


def copy_assets(assets: DataFrame, key: str, content: str, folder: str) -> DataFrame:
    """Writes each different key's bytes once, in the tasks that hold them; an asset of the same size is left. (key, path, size).

    ``folder`` must be a path that all executors see, as a shared mount."""

    def run(batches):
        import pandas as pd

        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            out = []
            for k, data in zip(b[key], b[content]):
                to = Path(folder) / k
                if not to.exists() or to.stat().st_size != len(data):
                    part = to.with_name(f".{to.name}.{uuid.uuid4().hex}")
                    part.write_bytes(data)
                    os.replace(part, to)
                out.append((k, str(to), len(data)))
            yield pd.DataFrame(out, columns=["key", "path", "size"])

    return assets.dropDuplicates([key]).select(key, content).mapInPandas(run, "key string, path string, size bigint")


