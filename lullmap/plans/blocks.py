"""Ordered per-series work that survives a hot series.

A window partitioned by series id puts one whole series into one task. That is the
cheapest plan while every series fits a task, and a dead end once a single series holds
a third of all rows. The operators therefore take a ``blocks`` argument saying how a
series is cut into consecutive pieces, and are written once for all of them:

* ``WholeSeries``  one piece per series: plain windows, one exchange, nothing to stitch;
* ``TimeBlocks``   pieces of fixed time width, derived from the timestamp alone;
* ``RangeBlocks``  pieces from Spark's sampled range partitioning, for orders that are
  not time, or for rows piled up on one instant.

``carry`` brings the summary of earlier (or later) pieces into each piece, ``islands``
groups consecutive rows and joins the groups that touch a piece boundary. Only piece
summaries and boundary groups are ever brought together per series: their number follows
the number of pieces, not the number of rows.

Series key columns are never null: joins between pieces would not find such rows again.

``pick_blocks`` chooses between the three by measuring; pass a choice on explicitly when
several operators run on the same series, so that it is measured once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullmap.plans.scratch import pinned

BLOCK = "__block"

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# Largest number of rows one task should sort for one series piece.
ROWS_PER_TASK = 20_000_000
# Widths tried, widest first, when a series is too large for one task.
WIDTHS = (30 * DAY, 7 * DAY, DAY, HOUR, MINUTE, SECOND)


@dataclass(frozen=True)
class WholeSeries:
    """Every series is one piece."""

    cols: tuple[str, ...] = ()

    def assign(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
        return df


@dataclass(frozen=True)
class TimeBlocks:
    """Pieces of ``width_us`` on the first order column, which must be BIGINT microseconds."""

    width_us: int
    cols: tuple[str, ...] = (BLOCK,)

    def assign(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
        ts = order[0] if isinstance(order[0], Column) else F.col(order[0])
        width = F.lit(self.width_us)
        return df.withColumn(BLOCK, floor_div(ts, width))


@dataclass(frozen=True)
class RangeBlocks:
    """``pieces`` pieces of about equal row count over (series, order), sampled by Spark.

    The piece number is the partition number, which a second evaluation could sample
    differently, so the numbered rows are written to the checkpoint folder once.
    """

    pieces: int
    cols: tuple[str, ...] = (BLOCK,)

    def assign(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
        ranged = df.repartitionByRange(self.pieces, *keys, *order)
        return pinned(ranged.withColumn(BLOCK, F.spark_partition_id().cast("long")))


Blocks = WholeSeries | TimeBlocks | RangeBlocks


def floor_div(a: Column, b: Column) -> Column:
    """Integer division rounding down, also for negative ``a``."""
    return F.call_function("div", a - F.pmod(a, b), b)


def int_div(a: Column, b: Column) -> Column:
    """Integer division of non-negative numbers."""
    return F.call_function("div", a, b)


def pick_blocks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    least_us: int = 0,
) -> Blocks:
    """Measure the largest series and choose the cheapest safe cut.

    The measurement is one map-side combined count that reads the key columns only, at every
    size of input. Where a series is too large and ``ts`` (BIGINT microseconds) is given, a
    second pass counts the pieces of all widths at once, and the widest that fits is taken;
    without ``ts``, or when even one second is too full, the pieces are sampled ranges.
    ``least_us`` asks for time pieces no narrower than that.
    """
    sizes = df.groupBy(*keys).count()
    total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
    if not total or largest <= rows_per_task:
        return WholeSeries()
    if ts is not None:
        widths = [w for w in WIDTHS if w >= least_us] or [least_us]
        width = F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("__width")
        cells = df.select(*keys, ts, width).groupBy(*keys, "__width", floor_div(F.col(ts), F.col("__width")).alias(BLOCK)).count()
        fullest = cells.groupBy("__width").agg(F.max("count")).collect()
        fit = [w for w, n in fullest if n <= rows_per_task]
        if fit or least_us:
            # Pieces that must not be narrower are no narrower, however full.
            return TimeBlocks(max(fit) if fit else min(widths))
    slots = df.sparkSession.sparkContext.defaultParallelism
    return RangeBlocks(max(2 * slots, -(-2 * total // rows_per_task)))


def interval_blocks(iv: DataFrame, keys: Sequence[str], ts: str, rows: Blocks) -> tuple[DataFrame, Blocks]:
    """Intervals made from rows cut as ``rows`` says, and how to cut the intervals.

    A series whose rows fit a task has fewer intervals. Otherwise the intervals are written
    once to the checkpoint folder and measured there.
    """
    if not rows.cols:
        return iv, rows
    held = pinned(iv)
    return held, pick_blocks(held, keys, ts)


def ordered(keys: Sequence[str], blocks: Blocks, order: Sequence[Column | str]):
    """Window over the rows of one series piece in order."""
    return Window.partitionBy(*keys, *blocks.cols).orderBy(*order)


def before(window):
    """All earlier rows, without the current one."""
    return window.rowsBetween(Window.unboundedPreceding, -1)


def upto(window):
    """All earlier rows and the current one."""
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Blocks,
    summary: dict[str, Column],
    outs: dict[str, tuple[str, str]],
) -> DataFrame:
    """Add what the pieces of the series say to every row of a piece.

    ``summary`` aggregates a piece, combining before the exchange; ``outs`` maps each new
    column to (kind, summary name). Kinds are ``lag`` and ``lead`` (neighbour piece),
    ``max_before`` and ``sum_before`` (all earlier pieces), and ``min_all``, ``max_all``
    and ``sum_all`` (the whole series). Without such pieces the value is null, or 0 for a
    sum. The result stays distributed by series and piece.
    """
    if not blocks.cols:
        whole = Window.partitionBy(*keys)
        alone = {"sum_before": F.lit(0)}
        return df.withColumns(
            {
                out: summary[n].over(whole) if kind.endswith("_all") else alone.get(kind, F.lit(None))
                for out, (kind, n) in outs.items()
            }
        )
    pieces = df.groupBy(*keys, *blocks.cols).agg(*[c.alias(f"__{n}") for n, c in summary.items()])
    series = Window.partitionBy(*keys)
    w = series.orderBy(*blocks.cols)
    forms = {
        "lag": lambda c: F.lag(c).over(w),
        "lead": lambda c: F.lead(c).over(w),
        "max_before": lambda c: F.max(c).over(before(w)),
        "sum_before": lambda c: F.coalesce(F.sum(c).over(before(w)), F.lit(0)),
        "min_all": lambda c: F.min(c).over(series),
        "max_all": lambda c: F.max(c).over(series),
        "sum_all": lambda c: F.sum(c).over(series),
    }
    brought = pieces.select(
        *keys, *blocks.cols, *[forms[kind](f"__{n}").alias(out) for out, (kind, n) in outs.items()]
    )
    return df.join(brought, [*keys, *blocks.cols])


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], blocks: Blocks, name: str = "pos"
) -> DataFrame:
    """1-based position of each row in its series."""
    cut = blocks.assign(df, keys, order)
    cut = carry(cut, keys, blocks, {"n": F.count(F.lit(1))}, {"__n_before": ("sum_before", "n")})
    pos = F.row_number().over(ordered(keys, blocks, order)).cast("long") + F.col("__n_before")
    return cut.withColumn(name, pos).drop("__n_before", *blocks.cols)


# Tasks over which the rows of one series are dealt when they meet what is known of the series.
SPREAD = 32
# Whole numbers of one array when a range becomes rows.
RANGE_STEP = 4096


def spread_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner", spread: int = SPREAD) -> DataFrame:
    """Join rows to a table of one row per key, without gathering a key in one task.

    Rows are dealt by a hash of their columns; the rows of ``per_key``, few beside them, are
    repeated for each share.
    """
    hashable = [n for n, t in rows.dtypes if not t.startswith(("map", "variant"))]
    share = F.pmod(F.xxhash64(*hashable), F.lit(spread)).cast("int")
    shares = F.explode(F.array(*[F.lit(i) for i in range(spread)]))
    copies = per_key.withColumn("__share", shares)
    return rows.withColumn("__share", share).join(copies, [*keys, "__share"], how).drop("__share")


def range_rows(df: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each whole number from ``first`` to ``last``, made in arrays of bounded size."""
    step = F.lit(RANGE_STEP)
    parts = F.when(first <= last, F.sequence(first, last, step.cast("long")))
    begun = df.withColumns({"__first": first, "__last": last}).withColumn("__part", F.explode(parts))
    within = F.sequence(F.col("__part"), F.least(F.col("__last"), F.col("__part") + RANGE_STEP - 1))
    return begun.withColumn(name, F.explode(within)).drop("__first", "__last", "__part")


_MERGE = {"min": F.min, "max": F.max, "sum": F.sum}


def islands(
    cut: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    blocks: Blocks,
    opens: Column,
    aggs: dict[str, tuple[str, Column]],
    keep: Column | None = None,
) -> DataFrame:
    """Group consecutive rows, a new group starting wherever ``opens`` is true.

    ``cut`` already carries the piece column. ``keep`` drops rows after the groups are
    numbered. ``aggs`` maps outputs to (min | max | sum, expression). A group that runs
    across piece boundaries is put together from its partial groups, of which at most two
    per piece can be concerned; all others stay where they are.
    """
    w = upto(ordered(keys, blocks, order))
    numbered = cut.withColumn("__group", F.sum(opens.cast("int")).over(w))
    if keep is not None:
        numbered = numbered.filter(keep)
    partial = numbered.groupBy(*keys, *blocks.cols, "__group").agg(
        *[_MERGE[fn](c).alias(out) for out, (fn, c) in aggs.items()]
    )
    if not blocks.cols:
        return partial.drop("__group")
    last = F.max("__group").over(Window.partitionBy(*keys, *blocks.cols))
    inner = (F.col("__group") > 0) & (F.col("__group") < last)
    laned = partial.withColumn("__lane", F.when(inner, F.col(BLOCK)))
    lane = upto(Window.partitionBy(*keys, "__lane").orderBy(BLOCK, "__group"))
    chained = laned.withColumn("__chain", F.sum((F.col("__group") > 0).cast("int")).over(lane))
    return (
        chained.groupBy(*keys, "__lane", "__chain")
        .agg(*[_MERGE[fn](out).alias(out) for out, (fn, _) in aggs.items()])
        .drop("__lane", "__chain")
    )
