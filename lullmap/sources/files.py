"""Byte sources read in ranges: PCM audio.

Files are listed by Spark and their bytes read inside tasks through Arrow's file systems,
so neither a file's size nor their number passes through the driver, and a very large
file is read by many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Samples per peak and full scale.
PEAK_SAMPLES, FULL_SCALE, SAMPLE_BYTES = 256, 32768.0, 2

RANGE_PEAKS = 65_536
FORMAT_EXTENSIBLE, FORMAT_PCM = 0xFFFE, 1


def arrow_place(path: str):
    """Arrow file system and inner path of a path as Spark writes it."""
    from pyarrow import fs

    # Spark writes local paths as file:/x, Arrow reads file:///x.
    short = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if short else path)


def _opened(path: str):
    system, inner = arrow_place(path)
    return system.open_input_file(inner)


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Give every few rows their own task; listing alone packs small rows together."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * slots, *columns)


def _samples_at(stream, size: int) -> tuple[int, int]:
    """Offset and byte count of the samples: the WAV data chunk, or the whole raw file."""
    head = stream.read_at(min(12, size), 0)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0, size
    at, wide = 12, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", stream.read_at(8, at))
        if name == b"fmt ":
            kind, channels, _, _, _, bits = struct.unpack("<HHIIHH", stream.read_at(16, at + 8))
            wide = kind in (FORMAT_PCM, FORMAT_EXTENSIBLE) and channels == 1 and bits == 16
        if name == b"data":
            if not wide:
                raise ValueError("only mono 16-bit PCM is read")
            return at + 8, min(length, size - at - 8)
        at += 8 + length + (length & 1)
    raise ValueError("a WAV file without data")


def read_pcm(spark: SparkSession, path: str, range_peaks: int = RANGE_PEAKS) -> DataFrame:
    """Peak per 256 samples of mono 16-bit WAV or raw files: ``source``, ``bucket``, ``peak``.

    The last, shorter bucket counts too; an odd trailing byte does not. Files are cut into
    byte ranges of whole buckets, so no bucket spans two tasks.
    """
    bucket_bytes = PEAK_SAMPLES * SAMPLE_BYTES

    def headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, size in zip(batch["path"], batch["length"]):
                with _opened(name) as stream:
                    rows.append((name, *_samples_at(stream, size)))
            yield pd.DataFrame(rows, columns=["source", "offset", "bytes"])

    def peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, at, count, first in zip(*(batch[c] for c in ("source", "at", "count", "first"))):
                with _opened(name) as stream:
                    raw = stream.read_at(count, at)
                loud = np.abs(np.frombuffer(raw, dtype="<i2", count=len(raw) // SAMPLE_BYTES).astype(np.int32))
                if not len(loud):
                    continue
                tops = np.maximum.reduceat(loud, np.arange(0, len(loud), PEAK_SAMPLES))
                yield pd.DataFrame(
                    {
                        "source": name,
                        "bucket": np.arange(first, first + len(tops)),
                        "peak": tops / FULL_SCALE,
                    }
                )

    files = _spread(_listed(spark, path).select("path", "length"), "path")
    found = files.mapInPandas(headers, "source string, offset bigint, bytes bigint")
    even = F.col("bytes") - F.col("bytes") % SAMPLE_BYTES
    step = range_peaks * bucket_bytes
    ranges = (
        found.withColumn("bytes", even)
        .filter(F.col("bytes") > 0)
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("bytes") - 1, F.lit(step)))))
        .select(
            "source",
            (F.col("offset") + F.col("k") * step).alias("at"),
            F.least(F.lit(step).cast("long"), F.col("bytes") - F.col("k") * step).alias("count"),
            (F.col("k") * range_peaks).alias("first"),
        )
    )
    return _spread(ranges, "source", "at").mapInPandas(peaks, "source string, bucket bigint, peak double")
