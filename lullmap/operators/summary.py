"""What a plan would cut, and what runs cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullmap.functions.units import fmt_bytes, fmt_clock, fmt_elapsed
from lullmap.operators.intervals import END, START
from lullmap.plans.blocks import Blocks, carry, int_div, ordered, pick_blocks, upto

# Fixed values of the estimates.
SIZE_LOW, SIZE_HIGH = 0.4, 0.6
MIN_WALL_S = 0.1
HEADROOM_SHARE, HEADROOM_BYTES = 0.2, 512 << 20
# method: typical factor, worst factor, and both factors of the source without a keep size.
SPACE_FACTORS = {
    "segment": (1.0, 2.5, 0.25, 0.9),
    "batch": (1.2, 2.0, 0.4, 0.7),
    "cut_then_encode": (1.1, 1.6, 0.35, 0.6),
}
SEGMENT_WORST_SHARE = 0.6


def plan_totals(plan: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number and total length of the quiet and the keep parts, in one aggregation."""
    length = F.greatest(F.lit(0), F.col(END) - F.col(START))
    of = lambda part: F.col("part") == part
    return plan.groupBy(*keys).agg(
        *[
            agg
            for part in ("quiet", "keep")
            for agg in (
                F.count_if(of(part)).alias(f"{part}_count"),
                F.sum(F.when(of(part), length).otherwise(0)).alias(f"{part}_us"),
            )
        ]
    )


def plan_summary(plan: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: how much is quiet, how much is kept, and the size to expect.

    ``plan`` comes from ``cut_plan``; ``series`` holds keys, ``end_us`` (null if unknown)
    and ``size_bytes``.
    """
    joined = (
        series.select(*keys, F.when(F.col(END) > 0, F.col(END)).alias("duration_us"), "size_bytes")
        .join(plan_totals(plan, keys), list(keys), "left")
        .na.fill(0, ["quiet_count", "quiet_us", "keep_count", "keep_us"])
    )
    span = F.col("duration_us").cast("double")
    ratio = F.col("keep_us") / span
    kept = F.col("keep_us") > 0
    estimate = lambda share: F.when(kept, F.floor(F.col("size_bytes") * ratio * share))
    return joined.withColumns(
        {
            "quiet_pct": F.lit(100.0) * F.col("quiet_us") / span,
            "keep_pct": F.lit(100.0) * ratio,
            "est_low_bytes": estimate(SIZE_LOW),
            "est_high_bytes": estimate(SIZE_HIGH),
        }
    )


def cut_summary(
    quiet: DataFrame, keep: DataFrame, series: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """``plan_summary`` of quiet and keep intervals held in two tables."""
    named = lambda iv, part: iv.select(*keys, F.lit(part).alias("part"), START, END)
    return plan_summary(named(quiet, "quiet").unionByName(named(keep, "keep")), series, keys)


def cut_report(summary: DataFrame) -> DataFrame:
    """Text columns for people next to a ``cut_summary``."""
    clock = lambda c: fmt_clock(F.call_function("div", F.col(c), F.lit(1_000_000)))
    return summary.withColumns(
        {
            "duration_text": clock("duration_us"),
            "quiet_text": clock("quiet_us"),
            "keep_text": clock("keep_us"),
            "size_text": fmt_bytes(F.col("size_bytes")),
            "est_text": F.concat_ws(
                " .. ", fmt_bytes(F.col("est_low_bytes")), fmt_bytes(F.col("est_high_bytes"))
            ),
        }
    )


def run_summary(runs: DataFrame) -> DataFrame:
    """Size change and speed of finished runs.

    ``runs`` holds ``src_bytes``, ``dst_bytes``, ``src_s`` and ``wall_s``. Adds
    ``change_pct``, its ``change`` (reduction or increase) and ``realtime_factor``,
    null where unknown.
    """
    src, dst = F.col("src_bytes"), F.col("dst_bytes")
    pct = F.when(src > 0, F.lit(100.0) * (src - dst) / F.when(src > 0, src))
    fast = (F.col("src_s") > 0) & (F.col("wall_s") > MIN_WALL_S)
    return runs.withColumns(
        {
            "change_pct": F.abs(pct),
            "change": F.when(pct >= 0, "reduction").when(pct < 0, "increase"),
            "realtime_factor": F.when(fast, F.col("src_s") / F.when(fast, F.col("wall_s"))),
            "src_text": fmt_bytes(src),
            "dst_text": fmt_bytes(dst),
            "wall_text": fmt_elapsed(F.col("wall_s")),
        }
    )


def space_estimate(runs: DataFrame) -> DataFrame:
    """Typical and worst bytes a run needs, by ``method``, headroom included.

    ``runs`` holds ``method``, ``size_bytes``, ``src_s`` and ``keep_s``.
    """
    size = F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long")
    known = (F.col("src_s") > 0) & (F.col("keep_s") > 0)
    ratio = F.when(known, F.least(F.lit(1.0), F.col("keep_s") / F.when(known, F.col("src_s"))))
    keep = (size * F.coalesce(ratio, F.lit(1.0))).cast("long")
    whole = lambda c: c.cast("long")

    def by_method(pick: int, bare: int) -> Column:
        chosen = F.lit(None).cast("long")
        for method, factors in SPACE_FACTORS.items():
            bytes_ = F.when(keep > 0, whole(keep * factors[pick])).otherwise(whole(size * factors[bare]))
            named = F.col("method") == method
            if method == "cut_then_encode":
                named = F.lit(True)
            chosen = F.coalesce(chosen, F.when(named, bytes_))
        return chosen

    segment = F.col("method") == "segment"
    typical = F.when(
        segment, F.greatest(keep, F.call_function("div", size, F.lit(4)))
    ).otherwise(by_method(0, 2))
    worst = by_method(1, 3)
    worst = F.when(segment, F.greatest(worst, whole(size * SEGMENT_WORST_SHARE))).otherwise(worst)
    headroom = F.greatest(whole(typical * HEADROOM_SHARE), F.lit(HEADROOM_BYTES))
    return runs.withColumns(
        {"typical_bytes": typical + headroom, "worst_bytes": worst + headroom}
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, blocks: Blocks | None = None
) -> DataFrame:
    """Exact median of ``value`` per key, from counts of equal values.

    The built-in exact percentile keeps every distinct value of a key in one aggregation
    buffer; here they are counted first and then passed in order.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    blocks = blocks or pick_blocks(counts, keys)
    cut = blocks.assign(counts, keys, [value])
    cut = carry(
        cut,
        keys,
        blocks,
        {"n": F.sum("__n")},
        {"__n_in": ("sum_before", "n"), "__total": ("sum_all", "n")},
    )
    upto_here = F.sum("__n").over(upto(ordered(keys, blocks, [value]))) + F.col("__n_in")
    placed = cut.withColumn("__upto", upto_here)
    total = F.col("__total")

    def at(k: Column) -> Column:
        covers = (F.col("__upto") - F.col("__n") <= k) & (k < F.col("__upto"))
        return F.max(F.when(covers, F.col(value)))

    low, high = int_div(total - 1, F.lit(2)), int_div(total, F.lit(2))
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / F.lit(2.0)).alias(value))


def preset_comparison(
    runs: DataFrame,
    baseline: str,
    preset: str = "preset",
    run: str = "run",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Median time, speed and size ratio of every preset against a baseline preset.

    ``runs`` holds ``time_s``, ``size_bytes`` and ``source_s``; the size is the last
    run's.
    """
    per = runs.groupBy(preset).agg(
        F.max_by("size_bytes", run).alias("size_bytes"), F.max("source_s").alias("source_s")
    ).join(exact_median(runs, [preset], "time_s", blocks), preset, "left")
    first = runs.filter(F.col(preset) == baseline).agg(F.max_by("size_bytes", run)).scalar()
    base = F.when(first > 0, first)
    time = F.when(F.col("time_s") > 0, F.col("time_s"))
    return per.withColumns(
        {
            "speed": F.coalesce(F.col("source_s") / time, F.lit(0.0)),
            "ratio": F.coalesce(F.col("size_bytes") / base, F.lit(0.0)),
        }
    ).drop("source_s")
