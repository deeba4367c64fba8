"""Interval algebra. An interval table holds the series keys, ``start_us`` and ``end_us``.

Times are BIGINT microseconds and intervals are half-open. Every operator works per
series; ``blocks`` says how long series are cut (see ``lullmap.plans.blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullmap.plans.blocks import (
    HOUR,
    SECOND,
    Blocks,
    before,
    carry,
    floor_div,
    int_div,
    islands,
    ordered,
    pick_blocks,
    spread_join,
)

START, END = "start_us", "end_us"
SPAN = (START, END)

# Fixed values of the interval model.
KEEP_FLOOR_US = 100_000
MAX_PIECE_US = 300 * SECOND
CHUNK_SIZE = 40
CHUNK_MIN = 5
CHUNK_MANY = 200
CHUNK_SOME = 100
CHUNK_LONG_US = HOUR


def _cut(iv: DataFrame, keys: Sequence[str], blocks: Blocks | None) -> tuple[DataFrame, Blocks]:
    blocks = blocks or pick_blocks(iv, keys, START)
    return blocks.assign(iv, keys, SPAN), blocks


def _merged(cut: DataFrame, keys: Sequence[str], blocks: Blocks, apart) -> DataFrame:
    """Join intervals of a cut table; ``apart`` says when a gap to all earlier ones separates."""
    cut = carry(cut, keys, blocks, {"end": F.max(END)}, {"__reach_in": ("max_before", "end")})
    reach = F.max(END).over(before(ordered(keys, blocks, SPAN)))
    cut = cut.withColumn("__reach", F.greatest(F.col("__reach_in").cast("long"), reach))
    opens = F.col("__reach").isNull() | apart(F.col(START) - F.col("__reach"))
    return islands(
        cut, keys, SPAN, blocks, opens, {START: ("min", F.col(START)), END: ("max", F.col(END))}
    )


def merge_intervals(
    iv: DataFrame,
    keys: Sequence[str],
    touch: bool = False,
    min_gap_us: int = 0,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Join overlapping intervals.

    Intervals that only touch stay apart unless ``touch``; with ``min_gap_us`` also
    those closer than that are joined.
    """
    cut, blocks = _cut(iv, keys, blocks)
    least = min_gap_us or (1 if touch else 0)
    return _merged(cut, keys, blocks, lambda gap: gap >= least)


def apply_margin(
    iv: DataFrame,
    keys: Sequence[str],
    margin_us: int | Column,
    ends: DataFrame | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Shrink (positive margin) or grow (negative) intervals, then merge what overlaps.

    Starts stay at or after 0 and, with ``ends`` (keys, or some of them, and ``end_us``),
    ends at or before the series end. Two intervals with rows between them grow at most to the midpoint of
    that gap, so growing never swallows it. Emptied intervals disappear.
    """
    margin = margin_us if isinstance(margin_us, Column) else F.lit(margin_us)
    cut, blocks = _cut(iv, keys, blocks)
    cut = carry(
        cut,
        keys,
        blocks,
        {"first": F.min(START), "last": F.max_by(END, F.struct(*SPAN))},
        {"__prev_in": ("lag", "last"), "__next_in": ("lead", "first")},
    )
    w = ordered(keys, blocks, SPAN)
    cut = cut.withColumns(
        {
            "__prev": F.coalesce(F.lag(END).over(w), F.col("__prev_in").cast("long")),
            "__next": F.coalesce(F.lead(START).over(w), F.col("__next_in").cast("long")),
        }
    )
    start, end, prev, nxt = (F.col(c) for c in (START, END, "__prev", "__next"))
    # greatest/least skip nulls, so a bound that does not apply is simply null.
    left_mid = F.when(prev < start, floor_div(prev + start, F.lit(2)))
    right_mid = F.when(end < nxt, floor_div(end + nxt, F.lit(2)))
    shaped = cut.select(
        *keys,
        F.greatest(F.lit(0), start + margin, left_mid).alias(START),
        F.least(end - margin, right_mid).alias(END),
    )
    if ends is not None:
        known = [k for k in keys if k in ends.columns]
        limit = ends.select(*known, F.col(END).alias("__limit"))
        shaped = shaped.join(limit, known, "left").withColumn(
            END, F.least(END, "__limit")
        ).drop("__limit")
    return merge_intervals(shaped.filter(start < end), keys, blocks=blocks)


def cut_plan(
    quiet: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    floor_us: int = KEEP_FLOOR_US,
    blocks: Blocks | None = None,
) -> DataFrame:
    """The quiet intervals and their complement in one table, told apart by ``part``.

    ``keep`` rows cover [0, end) of every series in ``ends`` except what is quiet: pieces
    shorter than ``floor_us`` are dropped, then pieces closer than ``floor_us`` joined.
    ``quiet`` rows are the given ones. Both come from one pass over the intervals, so a
    summary of the two does not compute them twice.

    Series without any quiet interval are kept whole. Series whose end is unknown or not
    positive give no rows; ``invalid_ends`` lists them.
    """
    blocks = blocks or pick_blocks(quiet, keys, START)
    known = ends.filter(F.col(END) > 0).select(*keys, F.col(END).alias("__limit"))
    inside = (F.col(START) < F.col("__limit")) & (F.col(END) > 0) & (F.col(START) < F.col(END))
    given = F.struct(F.lit("quiet").alias("part"), F.col(START).alias("s"), F.col(END).alias("e"))
    placed = known.join(quiet.select(*keys, *SPAN), list(keys), "left").select(
        *keys,
        "__limit",
        F.when(F.col(START).isNotNull(), given).alias("__given"),
        # Intervals outside the series become null rows, not missing ones: the last row
        # of a series must stay to carry the tail.
        F.when(inside, F.greatest(F.lit(0), START)).alias(START),
        F.when(inside, F.least("__limit", END)).alias(END),
    )
    order = (F.coalesce(START, F.lit(0)), F.coalesce(END, F.lit(0)))
    cut = blocks.assign(placed, keys, order)
    cut = carry(
        cut,
        keys,
        blocks,
        {"reach": F.max(END), "any": F.count(F.lit(1))},
        {"__reach_in": ("max_before", "reach"), "__more": ("lead", "any")},
    )
    w = ordered(keys, blocks, order)
    reach = F.coalesce(
        F.greatest(F.max(END).over(before(w)), F.col("__reach_in").cast("long")), F.lit(0)
    )
    final = F.lead(F.lit(1)).over(w).isNull() & F.col("__more").isNull()
    cut = cut.withColumns({"__reach": reach, "__final": final})

    def kept(start, end):
        return F.struct(F.lit("keep").alias("part"), start.alias("s"), end.alias("e"))

    passed, start, limit = F.col("__reach"), F.col(START), F.col("__limit")
    covered = F.greatest(passed, F.col(END))
    lead_in = F.when(start - passed >= max(floor_us, 1), kept(passed, start))
    tail = F.when(F.col("__final") & (limit - covered >= max(floor_us, 1)), kept(covered, limit))
    pieces = F.array_compact(F.array("__given", lead_in, tail))
    parts = cut.select(*keys, F.explode(pieces).alias("k")).select(
        *keys, "k.part", F.col("k.s").alias(START), F.col("k.e").alias(END)
    )
    if floor_us <= 0:
        return parts
    both = [*keys, "part"]
    return _merged(
        blocks.assign(parts, both, SPAN),
        both,
        blocks,
        lambda gap: (F.col("part") == "quiet") | (gap >= floor_us),
    )


def keep_intervals(
    quiet: DataFrame,
    ends: DataFrame,
    keys: Sequence[str],
    floor_us: int = KEEP_FLOOR_US,
    blocks: Blocks | None = None,
) -> DataFrame:
    """The ``keep`` part of ``cut_plan``: the complement of ``quiet`` within [0, end)."""
    return cut_plan(quiet, ends, keys, floor_us, blocks).filter(F.col("part") == "keep").drop("part")


def invalid_ends(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series that ``keep_intervals`` cannot plan, with the reason."""
    end = F.col(END)
    reason = F.when(end.isNull(), "unknown end").when(end <= 0, "end is not positive")
    return ends.select(*keys, END, reason.alias("reason")).filter(reason.isNotNull())


def split_long(iv: DataFrame, max_us: int = MAX_PIECE_US) -> DataFrame:
    """Cut intervals into contiguous pieces of at most ``max_us``."""
    last = F.greatest(F.lit(0), floor_div(F.col(END) - F.col(START) - 1, F.lit(max_us)))
    piece = F.col(START) + F.col("__k") * max_us
    return (
        iv.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumns({START: piece, END: F.least(piece + max_us, F.col(END))})
        .drop("__k")
    )


def chunk_intervals(
    iv: DataFrame, keys: Sequence[str], size: int = CHUNK_SIZE, blocks: Blocks | None = None
) -> DataFrame:
    """Group each series' intervals, in order, into chunks sized by how many there are."""
    length = F.col(END) - F.col(START)
    cut, blocks = _cut(iv, keys, blocks)
    cut = carry(
        cut,
        keys,
        blocks,
        {"n": F.count(F.lit(1)), "len": F.sum(length)},
        {"__n_in": ("sum_before", "n"), "__n": ("sum_all", "n"), "__total": ("sum_all", "len")},
    )
    pos = F.row_number().over(ordered(keys, blocks, SPAN)) + F.col("__n_in")
    counted = cut.withColumn("__pos", pos.cast("long"))
    n = F.col("__n")
    shared = lambda crowd: F.greatest(F.lit(CHUNK_MIN), int_div(F.lit(size * crowd), n))
    wanted = (
        F.when(n > CHUNK_MANY, shared(CHUNK_MANY))
        .when((n > CHUNK_SOME) & (F.col("__total") > CHUNK_LONG_US), shared(CHUNK_SOME))
        .otherwise(F.lit(size))
    )
    per_chunk = F.greatest(F.lit(CHUNK_MIN), F.least(wanted, F.lit(size)))
    return (
        counted.withColumn("chunk", int_div(F.col("__pos") - 1, per_chunk.cast("long")))
        .groupBy(*keys, "chunk")
        .agg(
            F.min(START).alias(START),
            F.max_by(END, F.struct(*SPAN)).alias(END),
            F.count(F.lit(1)).alias("intervals"),
            F.sum(length).alias("total_us"),
        )
    )


def project_to_buckets(
    iv: DataFrame, start_us: int, span_us: int, width: int, n_peaks: int | None = None
) -> DataFrame:
    """Map intervals to bucket ranges ``x_left``/``x_right`` of a view ``width`` buckets wide.

    Only what lies in [start_us, start_us + span_us) is mapped, at least one bucket wide.
    With ``n_peaks`` both edges first snap to the nearest of that many peak boundaries.
    """
    if span_us <= 0 or width <= 0:
        shown = iv.filter(F.lit(False))
    else:
        shown = view_window(iv, start_us, start_us + span_us)

    def place(c: str) -> Column:
        offset = F.col(c) - start_us
        if n_peaks:
            # Half-even rounding of offset * n_peaks / span, on integers.
            whole = int_div(offset * n_peaks, F.lit(span_us))
            twice = F.lit(2) * (offset * n_peaks - whole * span_us)
            up = (twice > span_us) | ((twice == span_us) & (whole % 2 == 1))
            peak = whole + up.cast("int")
            return int_div(peak * width, F.lit(n_peaks))
        return int_div(offset * width, F.lit(span_us))

    left, right = place(START), place(END)
    right = F.when(right == left, F.least(F.lit(width), left + 1)).otherwise(right)
    return shown.withColumns(
        {
            "x_left": F.greatest(F.lit(0), F.least(F.lit(width), left)).cast("long"),
            "x_right": F.greatest(F.lit(0), F.least(F.lit(width), right)).cast("long"),
        }
    )


def view_window(iv: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Clip intervals to [start_us, end_us); an inverted window is empty."""
    return (
        iv.filter((F.col(END) > start_us) & (F.col(START) < end_us) & (F.lit(start_us) < end_us))
        .withColumns(
            {START: F.greatest(F.lit(start_us), START), END: F.least(F.lit(end_us), END)}
        )
        .filter(F.col(START) < F.col(END))
    )


def view_buckets(
    peaks: DataFrame, start_us: int, end_us: int, durations: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Peaks (keys, ``bucket``, ``peak``) that cover [start_us, end_us) of each series.

    ``durations`` holds keys, ``end_us`` and ``n_peaks``: the peaks are spread evenly
    over [0, end_us). A bucket touched only in part is included.
    """
    total, n = F.col("__total"), F.col("__n")
    from_us = F.greatest(F.lit(0), F.least(F.lit(start_us), total))
    to_us = F.greatest(F.lit(0), F.least(F.lit(end_us), total))
    lo = floor_div(from_us * n, total)
    hi = F.least(n, F.greatest(lo + 1, floor_div(to_us * n + total - 1, total)))
    spread = durations.filter(F.col(END) > 0).select(
        *keys, F.col(END).alias("__total"), F.col("n_peaks").cast("long").alias("__n")
    )
    return (
        spread_join(peaks, spread, keys)
        .filter((from_us < to_us) & (F.col("bucket") >= lo) & (F.col("bucket") < hi))
        .drop("__total", "__n")
    )


def interval_totals(iv: DataFrame, keys: Sequence[str], ends: DataFrame | None = None) -> DataFrame:
    """Number and total length of intervals per series; with ``ends`` also the share."""
    length = F.greatest(F.lit(0), F.col(END) - F.col(START))
    totals = iv.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.sum(length).alias("total_us")
    )
    if ends is None:
        return totals
    return (
        ends.select(*keys, F.col(END).alias("span_us"))
        .join(totals, list(keys), "left")
        .na.fill(0, ["intervals", "total_us"])
        .withColumn("share", F.try_divide(F.col("total_us"), F.when(F.col("span_us") > 0, F.col("span_us"))))
    )
