"""Helpers shared by the operators: shared folders, written cuts, distributed ranks, text blocks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach, as spark.checkpoint.dir names it.

    Only a local session that names none gets a folder of its own; a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-fieldloom-")
    return _LOCAL_FOLDERS[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fieldloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, rows: int, per_bucket: int = 100_000) -> DataFrame:
    """Add a gapless rank from 0 within keys, without putting the rows of a key into one task.

    Rows are dealt into buckets of about per_bucket rows by a hash of the first order column; a bucket is ranked by a
    window, and the buckets before it are added as an offset. The offsets have a row for each key and bucket only.
    """
    buckets = max(1, math.ceil(rows / per_bucket))
    b = df.withColumn("_bucket", F.pmod(F.xxhash64(order[0]), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranks = b.withColumn("_rank", F.row_number().over(here) - 1)
    return (ranks.join(offsets, [*keys, "_bucket"])
            .withColumn(out, F.col("_rank") + F.col("_offset")).drop("_rank", "_offset", "_bucket"))


def text_blocks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow text column into runs of rows of about ``most`` bytes: first row, end row, bytes, offsets from 0.

    A null counts as an empty text; a text that is longer than ``most`` comes alone and whole.
    """
    if pa.types.is_large_string(texts.type):
        width = np.int64
    else:
        texts, width = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, width, n + 1, texts.offset * np.dtype(width).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, whole[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
        at = end


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(x))]))
                          for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def hashed_words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in data: start, end, row and a 64-bit hash of each.

    ``inside`` says for each byte value whether it belongs to a word. Words end at the end of a text. The hash is a
    polynomial over the bytes, taken from one running sum, then mixed.
    """
    return hashed_runs(data, offs, inside[data])


def hashed_runs(data: np.ndarray, offs: np.ndarray, flag: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As hashed_words, where ``flag`` says for each byte whether it belongs to a word, and ``begins`` where one begins in any case."""
    first, last = flag.copy(), flag.copy()
    first[1:] &= ~flag[:-1]
    if begins is not None:
        first |= begins
        last[:-1] &= begins[1:] | ~flag[1:]
    else:
        last[:-1] &= ~flag[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = flag[edge]
    last[edge - 1] = flag[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offs, start, "right") - 1
    powers, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:len(data)], out=total[1:])
        h = _mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return start, end, row, h
