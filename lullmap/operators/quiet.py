"""Detecting quiet stretches, gaps and bursts in measurement rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullmap.operators.intervals import END, KEEP_FLOOR_US, START, apply_margin, cut_plan
from lullmap.plans.blocks import Blocks, carry, interval_blocks, islands, ordered, pick_blocks, spread_join, upto

# Accepted ranges and defaults of the detector.
THRESHOLD_DB = (-60.0, -5.0)
MIN_LENGTH_S = (0.1, 60.0)
MARGIN_S = (-3.0, 5.0)
DEFAULT_DB, DEFAULT_MIN_S, DEFAULT_MARGIN_S = -30.0, 2.0, 0.5


def amplitude(threshold_db: float) -> float:
    """Linear amplitude of a level in dB, for a literal."""
    return math.pow(10.0, threshold_db / 20.0)


def _checked(name: str, value: float, bounds: tuple[float, float]) -> float:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} {value} is outside {bounds[0]}..{bounds[1]}")
    return value


def quiet_runs(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    quiet: Column,
    order: Sequence[str],
    ends: DataFrame | None,
    blocks: Blocks,
) -> DataFrame:
    """Maximal runs of ``quiet`` rows; a run ends where the next loud row is.

    A run still open after the last row is closed at the series end from ``ends``
    (keys, or some of them, and ``end_us``), and dropped without one. Rows are exchanged
    once, by series and piece, and read once.
    """
    lean = df.select(*keys, *dict.fromkeys([ts, *order]), F.coalesce(quiet, F.lit(False)).alias("__q"))
    cut = blocks.assign(lean, keys, order)
    w = ordered(keys, blocks, order)
    seen = {"__prev": F.lag("__q").over(w), "__next": F.lead(ts).over(w)}
    opens = F.col("__q") & ~F.coalesce("__prev", F.lit(False))
    parts = (
        cut.withColumns(seen)
        .withColumn("__group", F.sum(opens.cast("int")).over(upto(w)))
        # The first row of a piece stays even if loud: it ends a run of the piece before.
        .filter(F.col("__q") | F.col("__prev").isNull())
        .groupBy(*keys, *blocks.cols, "__group")
        .agg(
            F.min(ts).alias(START),
            F.max("__next").alias(END),
            F.bool_or("__q").alias("__q"),
            F.bool_or(F.col("__prev").isNull()).alias("__head"),
            F.bool_or(F.col("__q") & F.col("__next").isNull()).alias("__open"),
        )
    )
    columns = [*keys, START, END, "__open"]
    if not blocks.cols:
        runs = parts.filter("__q").select(columns)
    else:
        # Only runs that touch an edge of their piece meet those of other pieces: two a piece.
        w = Window.partitionBy(*keys).orderBy(*blocks.cols, "__group")
        goes_on = F.col("__head") & F.col("__q") & F.coalesce(F.lag("__open").over(w), F.lit(False))
        after = F.lead(START).over(w)
        edges = parts.filter("__head OR __open").withColumns({"__on": goes_on, "__after": after})
        chain = F.sum(F.when(F.col("__on"), 0).otherwise(1)).over(upto(w))
        stitched = (
            edges.withColumn("__chain", chain)
            .filter("__q")
            .groupBy(*keys, "__chain")
            .agg(
                F.min(START).alias(START),
                F.max(F.when(F.col("__open"), F.col("__after")).otherwise(F.col(END))).alias(END),
                F.bool_or(F.col("__open") & F.col("__after").isNull()).alias("__open"),
            )
        )
        inner = parts.filter("__q AND NOT __head AND NOT __open")
        runs = inner.select(columns).unionByName(stitched.select(columns))
    if ends is None:
        return runs.filter(~F.col("__open")).drop("__open")
    known = [k for k in keys if k in ends.columns]
    limit = ends.select(*known, F.col(END).alias("__limit"))
    closed = F.when(F.col("__open"), F.col("__limit")).otherwise(F.col(END))
    return (
        runs.join(limit, known, "left")
        .withColumn(END, closed)
        .filter(F.col(START) < F.col(END))
        .drop("__open", "__limit")
    )


def detect_quiet(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    threshold: float,
    min_len_us: int,
    ends: DataFrame | None = None,
    order: Sequence[str] | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Stretches of at least ``min_len_us`` in which |value| stays below ``threshold``.

    ``ts`` is BIGINT microseconds; ``order`` (default: ``ts``) breaks ties. The end of a
    run is compared against the series end, see ``quiet_runs``.
    """
    order = list(order or [ts])
    blocks = blocks or pick_blocks(df, keys, ts)
    runs = quiet_runs(df, keys, ts, F.abs(value) < F.lit(threshold), order, ends, blocks)
    return runs.filter(F.col(END) - F.col(START) >= min_len_us)


def plan_cut(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    threshold: float,
    min_len_us: int,
    margin_us: int,
    ends: DataFrame,
    floor_us: int = KEEP_FLOOR_US,
    order: Sequence[str] | None = None,
    blocks: Blocks | None = None,
) -> tuple[DataFrame, Blocks]:
    """From rows to quiet and keep parts, with the pieces that suit the intervals.

    Detection works on pieces of the rows. Its intervals are few: where the rows had to be
    split they are stored and measured by themselves, so that the steps after it are plain
    windows unless the intervals of one series are too many as well.
    """
    blocks = blocks or pick_blocks(df, keys, ts)
    quiet = detect_quiet(df, keys, ts, value, threshold, min_len_us, ends, order, blocks)
    quiet, own = interval_blocks(quiet, keys, START, blocks)
    return cut_plan(apply_margin(quiet, keys, margin_us, ends, own), ends, keys, floor_us, own), own


def detect_quiet_db(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    threshold_db: float = DEFAULT_DB,
    min_len_s: float = DEFAULT_MIN_S,
    ends: DataFrame | None = None,
    order: Sequence[str] | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """``detect_quiet`` with the threshold in dB and the length in seconds, range-checked."""
    _checked("threshold_db", threshold_db, THRESHOLD_DB)
    _checked("min_len_s", min_len_s, MIN_LENGTH_S)
    return detect_quiet(
        df, keys, ts, value, amplitude(threshold_db), round(min_len_s * 1e6), ends, order, blocks
    )


def detect_gaps(
    df: DataFrame, keys: Sequence[str], ts: str, max_gap_us: int, blocks: Blocks | None = None
) -> DataFrame:
    """Stretches longer than ``max_gap_us`` without any row."""
    blocks = blocks or pick_blocks(df, keys, ts)
    cut = blocks.assign(df.select(*keys, ts), keys, [ts])
    cut = carry(cut, keys, blocks, {"first": F.min(ts)}, {"__next_in": ("lead", "first")})
    nxt = F.coalesce(F.lead(ts).over(ordered(keys, blocks, [ts])), F.col("__next_in").cast("long"))
    return cut.select(*keys, F.col(ts).alias(START), nxt.alias(END)).filter(
        F.col(END) - F.col(START) > max_gap_us
    )


def activity_sessions(
    df: DataFrame, keys: Sequence[str], ts: str, max_gap_us: int, blocks: Blocks | None = None
) -> DataFrame:
    """Bursts of rows no further apart than ``max_gap_us``: first and last row, row count."""
    blocks = blocks or pick_blocks(df, keys, ts)
    cut = blocks.assign(df.select(*keys, ts), keys, [ts])
    cut = carry(cut, keys, blocks, {"last": F.max(ts)}, {"__prev_in": ("lag", "last")})
    prev = F.coalesce(F.lag(ts).over(ordered(keys, blocks, [ts])), F.col("__prev_in").cast("long"))
    cut = cut.withColumn("__prev", prev)
    opens = F.col("__prev").isNull() | (F.col(ts) - F.col("__prev") > max_gap_us)
    return islands(
        cut,
        keys,
        [ts],
        blocks,
        opens,
        {START: ("min", F.col(ts)), END: ("max", F.col(ts)), "rows": ("sum", F.lit(1))},
    )


def below_threshold_runs(
    peaks: DataFrame, keys: Sequence[str], threshold: float, width: int
) -> DataFrame:
    """Runs of view columns whose peak is below ``threshold``, without a minimum length.

    ``peaks`` holds keys, ``bucket`` (0-based, dense) and ``peak``. A view of ``width``
    columns shows the largest peak of each column, or repeats peaks when there are fewer
    than columns. A series thereby holds at most ``width`` rows before any ordering.
    """
    n = F.col("__n")
    sized = spread_join(peaks, peaks.groupBy(*keys).agg((F.max("bucket") + 1).cast("long").alias("__n")), keys)
    # Column x shows peaks [x*n div width, max(that + 1, (x+1)*n div width)).
    first = F.call_function("div", F.col("bucket") * width, n)
    lo = F.greatest(F.lit(0), first - 1)
    hi = F.least(F.lit(width - 1), F.call_function("div", (F.col("bucket") + 1) * width, n) + 1)
    x = F.col("x")
    left = F.call_function("div", x * n, F.lit(width))
    right = F.greatest(left + 1, F.call_function("div", (x + 1) * n, F.lit(width)))
    columns = (
        sized.withColumn("x", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
        .filter((F.col("bucket") >= left) & (F.col("bucket") < right))
        .groupBy(*keys, "x")
        .agg(F.max("peak").alias("peak"))
        .filter(F.col("peak") < F.lit(threshold))
    )
    run = F.col("x") - F.row_number().over(Window.partitionBy(*keys).orderBy("x"))
    return (
        columns.withColumn("__run", run)
        .groupBy(*keys, "__run")
        .agg(F.min("x").alias("x_left"), (F.max("x") + 1).alias("x_right"))
        .drop("__run")
    )
