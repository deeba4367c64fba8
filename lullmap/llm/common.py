"""What the operators of this subpackage share: stored tables, Arrow batches as bytes, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.plans.scratch import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Text handled at once inside a task; arrays of eight bytes a character are made of it.
SLICE_BYTES = 1 << 21
# The same for steps that gain nothing from more texts at once.
NARROW_BYTES = 1 << 19
# Rows that a Python worker gets at once, in bytes. Spark's 64 MB are held by the worker, by what it
# makes of them and by the buffers of the JVM on both ways.
BATCH_BYTES = 4 << 20


def query(name: str, sql: str | None = None):
    """Register a query and, if it can be stated in SQL, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: every later use sees the same rows."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Have the session hand rows to Python in batches of ``BATCH_BYTES``, unless it has a limit of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, base: str) -> str:
    """``base``, or with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id's text divisible by five."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def text_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def text_arrays(batch: pa.RecordBatch, column: int | str) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and ``len + 1`` offsets; null counts as empty."""
    arr = batch.column(column)
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data, offsets


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and end row, bytes, offsets from 0."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` takes the hash of any stretch of ``data``."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= powers(n + 1)[1][:n]
    np.cumsum(values, out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    h = sums[end] - sums[start]
    h *= powers(len(sums))[0][start]
    h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def span_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of every stretch of ``size`` bytes, by its start."""
    h = sums[size:] - sums[:-size]
    h *= powers(len(sums))[0][: len(h)]
    h += np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    return mixed(h)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE):
    """Words of concatenated texts: starts, ends, hashes with A-Z lowered, first word of each text.

    A word is a run of bytes not marked in ``apart``; none crosses from one text to the next.
    """
    n = len(data)
    inside = ~apart[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = span_hash(prefix_sums(_LOWER[data]), start, end)
    return start, end, h, np.searchsorted(start, offsets)
