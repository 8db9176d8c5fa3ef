"""Readers: text, records, captions, folders, logs, shards, and tensor files by header."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text

#: name: (repository or folder, split or file, column, title); what is not on this machine is skipped.
PRESETS = {
    "mj_prompts": ("prompts", "mj_prompts", "text", "Prompts of an image bot"),
    "sd_prompts": ("prompts", "sd_prompts", "text", "Prompts of an open model"),
    "vid_prompts": ("prompts", "vid_prompts", "text", "Prompts for video"),
    "ddb_meta": ("prompts", "ddb_meta", "text", "Prompts with metadata"),
}
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]


def column_or_first(df: DataFrame, column: str) -> DataFrame:
    """The texts of a column, or of the first one if it is missing; null and empty ones fall out."""
    name = column if column in df.columns else df.columns[0]
    return df.select(F.col(f"`{name}`").cast("string").alias("text")).where("text <> ''")


def preset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a preset from the prompt table; an unknown name gives none."""
    rows = spark.read.parquet(f"{folder}/prompts.parquet")
    return rows.where(F.col("source") == PRESETS[name][1]) if name in PRESETS else rows.limit(0)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): a row a line; blank lines are rows."""
    return spark.read.option("lineSep", "\n").text(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a malformed line fails the read, blank lines are none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """(text, images) of a corpus: records from .jsonl, else a text a line."""
    if path.rstrip("/").endswith(".jsonl"):
        return records(spark, path, "text string, images array<string>")
    return lines(spark, path).select(F.col("value").alias("text"), F.array().cast("array<string>").alias("images"))


def latest(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """One row for each key: the value of the last delivery (of equal times the largest value). Rows with a null last key fall out."""
    last = F.max(F.struct(time, value)).alias("r")
    return rows.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(last).select(*keys, f"r.{time}", f"r.{value}")


def caption_lists(rows: DataFrame, raw: str) -> DataFrame:
    """``captions``: the trimmed non-empty captions of a JSON list; broken JSON gives none."""
    parsed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
    valid = F.col(raw).rlike(r"^\s*\[") & F.get_json_object(raw, "$").isNotNull()
    kept = F.filter(F.transform(F.when(valid, parsed), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    return rows.withColumn("captions", F.coalesce(kept, F.array().cast("array<string>"))).drop(raw)


def caption_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captions from CSV whose ``raw`` is a JSON list; rows without filename fall out."""
    got = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return caption_lists(got.where("filename is not null"), "raw")


def caption_parquet(spark: SparkSession, path: str, caption: str) -> DataFrame:
    """(file, key, captions) of caption files: ``caption`` a string or a list; the key is the file's stem and the row's place in it."""
    df = with_row_keys(spark, path)
    as_list = F.col(caption) if dict(df.dtypes)[caption].startswith("array") else F.array(caption)
    kept = F.filter(F.transform(as_list, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    return df.select(F.col("_metadata.file_path").alias("file"), "key", kept.alias("captions"))


def folder(spark: SparkSession, path: str, suffixes: list[str] = IMAGE_SUFFIXES) -> DataFrame:
    """(path, length, captions) of the images below a folder, captions from a text file of the same stem."""
    images = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    images = images.where(text.suffix(F.col("path")).isin(suffixes))
    notes = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    key = lambda c: F.concat_ws("/", text.parent(c), text.stem(c))
    said = notes.select(key(F.col("path")).alias("k"), F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: F.trim(x) != "").alias("captions"))
    return images.withColumn("k", key(F.col("path"))).join(said, "k", "left").select("path", "length", F.coalesce("captions", F.array().cast("array<string>")).alias("captions"))


def image_suffix(path: Column, content: Column) -> Column:
    """The suffix of a path, else .png if the bytes say so, else .jpg."""
    own = text.suffix(path)
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return F.when(own != "", own).when(png, ".png").otherwise(".jpg")


def metrics(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A metrics log: the step as a whole number, the rest as numbers; rows with a field missing or broken fall out."""
    raw = spark.read.option("header", True).csv(path)
    typed = raw.select(F.col("step").try_cast("int").alias("step"), *(F.col(c).try_cast("double").alias(c) for c in columns))
    return typed.dropna()


def shard_rows(shards: DataFrame) -> DataFrame:
    """A row a sample of packed shards: (split, shard, pos, text, len, n_images); null counts are 0."""
    z = shards.select("split", "shard", F.posexplode(F.arrays_zip("prompts", "len", "n_images")).alias("pos", "s"))
    return z.select("split", "shard", "pos", F.coalesce("s.prompts", F.lit("")).alias("text"), F.col("s.len").alias("len"), F.coalesce("s.n_images", F.lit(0)).alias("n_images"))


def listing(path: str, suffix: str = "") -> list[tuple[str, bool, int]]:
    """(name, is a folder, size): folders first, then by name without case; hidden ones are left out."""
    rows = [(p.name, p.is_dir(), 0 if p.is_dir() else p.stat().st_size) for p in Path(path).iterdir() if not p.name.startswith(".")]
    return sorted((r for r in rows if r[1] or r[0].endswith(suffix)), key=lambda r: (not r[1], r[0].lower()))


def shard_files(path: str) -> list[str]:
    """The committed shard files of a folder; none is an error."""
    got = sorted(p.name for p in Path(path).glob("*.npz") if not p.name.endswith(".tmp.npz"))
    if not got:
        raise FileNotFoundError(f"no shards in {path}")
    return got


def tensor_header(path: str) -> dict:
    """The header of a safetensors file: name to dtype, shape and byte range; no tensor is read."""
    with open(path, "rb") as f:
        return {k: v for k, v in json.loads(f.read(struct.unpack("<Q", f.read(8))[0])).items() if k != "__metadata__"}


_DTYPES = {"F32": np.float32, "F16": np.float16, "F64": np.float64, "I32": np.int32, "I64": np.int64, "U8": np.uint8, "BF16": np.uint16}


def from_bf16(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint32) << 16).view(np.float32)


def to_bf16(values: np.ndarray) -> np.ndarray:
    """bfloat16 bits, rounded to even."""
    x = values.astype(np.float32).view(np.uint32)
    return ((x + 0x7FFF + ((x >> 16) & 1)) >> 16).astype(np.uint16)


def tensors(spark: SparkSession, paths: list[str], wanted: Callable[[str], bool] = lambda _: True) -> DataFrame:
    """(name, dtype, shape, data ARRAY<FLOAT>) of the wanted tensors; a task a file, and only their byte ranges are read."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for path in b["path"]:
                with open(path, "rb") as f:
                    base = 8 + struct.unpack("<Q", f.read(8))[0]
                    for name, t in sorted(tensor_header(path).items()):
                        if wanted(name):
                            f.seek(base + t["data_offsets"][0])
                            raw = np.frombuffer(f.read(t["data_offsets"][1] - t["data_offsets"][0]), _DTYPES[t["dtype"]])
                            values = from_bf16(raw) if t["dtype"] == "BF16" else raw.astype(np.float32)
                            yield pd.DataFrame({"name": [name], "dtype": [t["dtype"]], "shape": [list(map(int, t["shape"]))], "data": [values]})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(read, "name string, dtype string, shape array<int>, data array<float>")


def header_bytes(paths: list[str], wanted: Callable[[str], bool] = lambda _: True) -> int:
    """Bytes of the wanted tensors, from the headers alone."""
    return sum(t["data_offsets"][1] - t["data_offsets"][0] for p in paths for k, t in tensor_header(p).items() if wanted(k))


def index_files(index: str) -> list[str]:
    """The different files of a weight index."""
    return sorted(set(json.loads(Path(index).read_text())["weight_map"].values()))


def tail(path: str, after: int, limit: int = 1 << 18) -> dict:
    """The log's text after an offset: {text, next, size}. A shorter file starts anew; a first read of a long one starts
    at its last ``limit`` bytes, after the line that is cut."""
    p = Path(path)
    size = p.stat().st_size if p.exists() else 0
    if after > size:
        after = 0
    with p.open("rb") as f:
        if after == 0 and size > limit:
            f.seek(size - limit)
            f.readline()
        else:
            f.seek(after)
        at = f.tell()
        data = f.read(limit)
    return {"text": data.decode(errors="replace"), "next": at + len(data), "size": size}


def zip_members(spark: SparkSession, paths: list[str], keys: DataFrame) -> DataFrame:
    """(key, content) of the members of zip files whose file name is ``key``; of several the last of the last file counts. A task an archive, and a member
    is unpacked only if a key asks for it; ``keys`` (key) is sent to the tasks by a join on the listing, not as a list."""

    def list_(batches: Iterator) -> Iterator:
        import zipfile

        import pandas as pd

        for b in batches:
            for at, path in zip(b["at"], b["path"]):
                names = [n for n in zipfile.ZipFile(path).namelist() if not n.endswith("/")]
                yield pd.DataFrame({"at": at, "path": path, "place": range(len(names)), "member": names, "key": [n.rsplit("/", 1)[-1] for n in names]})

    def unpack(batches: Iterator) -> Iterator:
        import zipfile

        import pandas as pd

        for b in batches:
            for path, part in b.groupby("path", sort=False):
                with zipfile.ZipFile(path) as z:
                    yield pd.DataFrame({"key": part["key"].to_numpy(), "content": [z.read(m) for m in part["member"]]})

    files = spark.createDataFrame(list(enumerate(paths)), "at int, path string").repartition(max(1, len(paths)))
    listed = files.mapInPandas(list_, "at int, path string, place bigint, member string, key string")
    last = listed.groupBy("key").agg(F.max_by(F.struct("path", "member"), F.struct("at", "place")).alias("m"))
    wanted = last.join(keys.select("key").distinct(), "key").select("key", "m.path", "m.member")
    return wanted.repartition("path").mapInPandas(unpack, "key string, content binary")


def with_row_keys(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder with ``key``: the file's stem and the row's place in the file, which no split size changes."""
    df = spark.read.parquet(path)
    return df.select("*", F.concat_ws("-", text.stem(F.col("_metadata.file_path")), F.col("_metadata.row_index")).alias("key"))


def rows_by_key(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of ``with_row_keys`` whose key is asked for."""
    return with_row_keys(spark, path).join(keys.select("key").distinct(), "key")


def captions(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Captions of any of the known layouts: "csv" (options: schema), "parquet" (caption), or "folder" of images."""
    known = {"csv": lambda: caption_csv(spark, path, options["schema"]), "parquet": lambda: caption_parquet(spark, path, options["caption"]), "folder": lambda: folder(spark, path)}
    if kind not in known:
        raise ValueError(f"no layout {kind!r}; there are {', '.join(known)}")
    return known[kind]()


#: Columns of a device table as the driver's tool prints it, comma separated and without units.
DEVICE = "name string, memory_total double, memory_used double, utilisation double, temperature double"


def devices(spark: SparkSession, printed: str) -> DataFrame:
    """(index, name, memory_total, memory_used, utilisation, temperature) of a printed device table; what is no number is null, short lines fall out."""
    names = [x.split()[0] for x in DEVICE.split(", ")]
    rows = [[y.strip() for y in x.split(",")] for x in printed.splitlines() if x.count(",") == len(names) - 1]
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "index int, " + ", ".join(f"{n} string" for n in names))
    return raw.select("index", "name", *(F.col(n).try_cast("double").alias(n) for n in names[1:]))


def host(spark: SparkSession) -> dict:
    """What the session runs on."""
    import platform

    sc = spark.sparkContext
    return {"python": platform.python_version(), "spark": spark.version, "system": platform.system(), "cores": sc.defaultParallelism, "master": sc.master}


def tokenizer(path: str):
    """A tokenizer from its JSON file, if the library for it is installed; else a ValueError that says so."""
    try:
        from tokenizers import Tokenizer
    except ImportError as e:
        raise ValueError("the tokenizers library is not installed") from e
    return Tokenizer.from_file(path)
