"""Trying many detection parameters in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullmap.operators.intervals import END, START, apply_margin, cut_plan
from lullmap.operators.quiet import quiet_runs
from lullmap.operators.summary import plan_totals
from lullmap.plans.blocks import Blocks, carry, interval_blocks, ordered, pick_blocks


def parameter_sweep(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    grid: Sequence[tuple[float, int, int]],
    ends: DataFrame,
    floor_us: int = 100_000,
    order: Sequence[str] | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Quiet and keep totals for every (threshold, min_len_us, margin_us) of ``grid``.

    Rows are never multiplied by the grid. A row first gets its level: how many of the
    distinct thresholds it reaches. A row can open or close a run only at the thresholds
    between its level and that of the row before, so it is repeated for just those;
    minimum length and margin are applied to the resulting intervals. The whole grid takes
    one exchange of the rows.
    """
    if not grid:
        raise ValueError("the grid must have a point")
    order = list(order or [ts])
    blocks = blocks or pick_blocks(df, keys, ts)
    ends = ends.select(*keys, END)
    thresholds = sorted({float(t) for t, _, _ in grid})
    steps = len(thresholds)

    loud = F.abs(value)
    level = sum((F.when(loud >= t, 1).otherwise(0) for t in thresholds), F.lit(0))
    level = F.when(loud.isNull(), steps).otherwise(level)
    lean = df.select(*keys, *dict.fromkeys([ts, *order]), level.alias("__level"))
    cut = blocks.assign(lean, keys, order)
    cut = carry(
        cut, keys, blocks, {"last": F.max_by("__level", F.struct(*order))}, {"__prev_in": ("lag", "last")}
    )
    prev = F.coalesce(F.lag("__level").over(ordered(keys, blocks, order)), F.col("__prev_in").cast("int"))
    first = F.col("__prev").isNull()
    low = F.when(first, 0).otherwise(F.least("__prev", "__level"))
    high = F.when(first, steps).otherwise(F.greatest("__prev", "__level"))
    turns = (
        cut.withColumn("__prev", prev)
        .filter(first | (F.col("__prev") != F.col("__level")))
        .withColumn("step", F.explode(F.sequence(low, high - 1)))
        .drop("__prev", "__prev_in", *blocks.cols)
    )
    runs = quiet_runs(
        turns, [*keys, "step"], ts, F.col("__level") <= F.col("step"), order, ends, blocks
    )

    # Intervals are few beside the rows: those of split rows are cut as they need it themselves.
    runs, blocks = interval_blocks(runs, [*keys, "step"], START, blocks)

    # The grid as a literal array, so that repeating by it needs no join.
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("point"),
                F.lit(thresholds.index(float(t))).alias("step"),
                F.lit(float(t)).alias("threshold"),
                F.lit(int(m)).cast("long").alias("min_len_us"),
                F.lit(int(g)).cast("long").alias("margin_us"),
            )
            for i, (t, m, g) in enumerate(grid)
        ]
    )
    length = F.col(END) - F.col(START)
    asked = F.filter(
        points, lambda p: (p["step"] == F.col("step")) & (p["min_len_us"] <= length)
    )
    wide = [*keys, "point"]
    raw = runs.withColumn("p", F.explode(asked)).select(
        *keys, "p.point", "p.margin_us", START, END
    )
    spans = ends.withColumn("p", F.explode(points)).select(
        *keys, END, "p.point", "p.threshold", "p.min_len_us", "p.margin_us"
    )
    # A point number has one margin, so carrying it as a key splits nothing.
    quiet = apply_margin(raw, [*wide, "margin_us"], F.col("margin_us"), ends, blocks)
    plan = cut_plan(quiet, spans, wide, floor_us, blocks)
    return (
        spans.withColumnRenamed(END, "span_us")
        .join(plan_totals(plan, wide), wide, "left")
        .na.fill(0, ["quiet_count", "quiet_us", "keep_count", "keep_us"])
        .drop("point")
    )


def sweep_totals(per_series: DataFrame) -> DataFrame:
    """The sweep over all series together, one row per grid point."""
    return per_series.groupBy("threshold", "min_len_us", "margin_us").agg(
        *[F.sum(c).alias(c) for c in ("quiet_count", "quiet_us", "keep_count", "keep_us", "span_us")]
    )
