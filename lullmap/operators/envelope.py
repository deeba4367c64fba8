"""Down-sampling a series to an envelope, and signal statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullmap.plans.blocks import Blocks, carry, int_div, ordered, pick_blocks, positions

# Samples of a window of the dominant frequency.
SPECTRUM_SAMPLES = 8192


def envelope(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    buckets: int,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Largest |value| in each of exactly ``buckets`` equal shares of a series' rows.

    Bucket i of t covers rows [i*n div t, (i+1)*n div t), so row j falls into bucket
    ((j+1)*t - 1) div n. A series with fewer rows than buckets is passed through.
    """
    blocks = blocks or pick_blocks(df, keys, order[0])
    lean = df.select(*keys, *dict.fromkeys([*order, value]))
    cut = carry(
        blocks.assign(lean, keys, order),
        keys,
        blocks,
        {"n": F.count(F.lit(1))},
        {"__n_in": ("sum_before", "n"), "__n": ("sum_all", "n")},
    )
    pos = F.row_number().over(ordered(keys, blocks, order)) + F.col("__n_in")
    placed = cut.withColumn("__j", pos.cast("long"))
    j, n = F.col("__j"), F.col("__n")
    bucket = F.when(n <= buckets, j - 1).otherwise(int_div(j * buckets - 1, n))
    return placed.groupBy(*keys, bucket.cast("int").alias("bucket")).agg(
        F.max(F.abs(value)).alias("peak")
    )


def signal_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Row count, RMS and mean (DC offset) per series."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("samples"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean")
    )


def dominant_frequency(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    rate: float,
    blocks: Blocks | None = None,
    window: int = SPECTRUM_SAMPLES,
) -> DataFrame:
    """Strongest non-DC frequency of every series, from the mean power of its windows.

    A series is cut by position into windows of ``window`` samples under a Hann taper, of
    which a task handles one at a time; the rest at its end is filled up with zeros. Powers
    are summed by frequency before they meet. A series of one short window is taken as it is.
    """
    blocks = blocks or pick_blocks(df, keys)
    lean = df.select(*keys, *dict.fromkeys([*order, value]))
    placed = positions(lean, keys, order, blocks, "__j").select(
        *keys,
        int_div(F.col("__j") - 1, F.lit(window)).alias("__w"),
        "__j",
        F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("__v"),
    )
    held = F.sort_array(F.collect_list(F.struct("__j", "__v")))
    windows = placed.groupBy(*keys, "__w").agg(F.transform(held, lambda x: x["__v"]).alias("__v"))

    @F.pandas_udf("struct<n: bigint, p: array<double>>")
    def spectrum(place: pd.Series, values: pd.Series) -> pd.DataFrame:
        sizes = [len(v) if w == 0 else window for w, v in zip(place, values)]
        power = [np.abs(np.fft.rfft(v * np.hanning(len(v)), n))[1:] ** 2 for v, n in zip(values, sizes)]
        return pd.DataFrame({"n": sizes, "p": power})

    told = windows.withColumn("__s", spectrum("__w", "__v"))
    powers = told.select(*keys, F.col("__s.n").alias("__n"), F.posexplode_outer("__s.p").alias("__k", "__p"))
    powers = powers.withColumn("__k", (F.col("__k") + 1).cast("long"))
    summed = powers.groupBy(*keys, "__n", "__k").agg(F.sum("__p").alias("__p"))
    best = F.max_by(F.col("__k") * F.lit(float(rate)) / F.col("__n"), F.struct("__p", -F.col("__k")))
    return summed.groupBy(*keys).agg(best.alias("frequency"))
