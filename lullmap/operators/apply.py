"""Applying an interval plan to rows: trim, close gaps, resample, pad, join parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullmap.operators.intervals import END, SPAN, START, merge_intervals
from lullmap.plans.blocks import (
    SECOND,
    Blocks,
    before,
    carry,
    floor_div,
    int_div,
    ordered,
    pick_blocks,
    range_rows,
    spread_join,
)
from lullmap.plans.scratch import pinned

# Target rates a plan may ask for; "source" leaves the cadence alone.
RATES = ("source", "24", "25", "30", "50", "60")


# Bits of the radix that interval lengths are rounded up to, and of the widest cells there are.
RADIX_BITS, WIDEST_BITS = 4, 60
# Bits of the shares that the rows of one cell as wide as all intervals together are dealt over.
SHARE_BITS = 5
# Ends of the time before the first and after the last interval of a series.
NEVER, FOREVER = -(1 << 61), 1 << 61


def _bits(length: Column) -> Column:
    """Exponent of the cells an interval of that length lies in at most two of."""
    exact = F.length(F.bin(length - 1)) + (RADIX_BITS - 1)
    return F.least(int_div(exact, F.lit(RADIX_BITS)).cast("int") * RADIX_BITS, F.lit(WIDEST_BITS))


def interval_cells(iv: DataFrame, levels: dict[int, int]) -> DataFrame:
    """A row for each power-of-two cell that an interval touches, with ``__bits``, ``__cell`` and ``__share``.

    Cells are at least as long as the interval, so there are two at most, each repeated for the
    shares (``levels``: exponent to number) in which the rows of so wide a cell are dealt.
    """
    at = lambda c: F.call_function("shiftright", c, F.col("__bits"))
    shares = F.element_at(F.create_map(*[F.lit(x) for pair in levels.items() for x in pair]), F.col("__bits"))
    return (
        iv.withColumn("__bits", _bits(F.col(END) - F.col(START)))
        .withColumn("__cell", F.explode(F.sequence(at(F.col(START)), at(F.col(END) - 1))))
        .withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1)))
    )


def _levels(iv: DataFrame) -> dict[int, int]:
    """Exponents of the cells in use, and in how many shares the rows of a cell are dealt.

    Only a cell about as wide as the time of all intervals can hold most rows of a series;
    intervals of that length are few.
    """
    met = iv.groupBy(_bits(F.col(END) - F.col(START)).alias("b")).agg(F.min(START), F.max(END)).collect()
    if not met:
        return {}
    span = max(r[2] for r in met) - min(r[1] for r in met)
    return {r["b"]: 1 << max(0, min(SHARE_BITS, SHARE_BITS + r["b"] - span.bit_length())) for r in met}


def _complement(iv: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The time of each series of ``iv`` outside all its intervals, from ``NEVER`` to ``FOREVER``."""
    blocks = pick_blocks(iv, keys, START)
    merged = merge_intervals(iv.select(*keys, *SPAN), keys, touch=True, blocks=blocks)
    first = merged.groupBy(*keys).agg(F.lit(NEVER).alias(START), F.min(START).alias(END))
    cut = blocks.assign(merged, keys, SPAN)
    cut = carry(cut, keys, blocks, {"first": F.min(START)}, {"__next_in": ("lead", "first")})
    after = F.coalesce(F.lead(START).over(ordered(keys, blocks, SPAN)), F.col("__next_in").cast("long"), F.lit(FOREVER))
    between = cut.select(*keys, F.col(END).alias(START), after.alias(END))
    return first.unionByName(between).filter(F.col(START) < F.col(END))


def interval_join(
    rows: DataFrame,
    iv: DataFrame,
    keys: Sequence[str],
    ts: str,
    how: str = "inner",
) -> DataFrame:
    """Join rows to the intervals of their series that contain their time.

    ``how`` is inner, left, left_semi or left_anti. An interval lies in the one or two cells of
    the least power of 16 that is not shorter; a row looks into one cell of every width in use,
    which is measured. So a year and a second stand in one table as they are: neither is cut
    into days, and a row meets only intervals within some lengths of its time. Rows without a
    match are found by the intervals' complement, so that nothing is looked up twice.

    Empty intervals match nothing, rows without a time neither. Columns of ``iv`` besides the
    keys are added. The intervals, few beside the rows, are written to the checkpoint folder.
    """
    iv = pinned(iv.filter(F.col(START) < F.col(END)))
    outer = how in ("left", "left_anti")
    if how == "left_semi":
        iv = merge_intervals(iv.select(*keys, *SPAN), keys, touch=True)
    levels = _levels(iv)
    if how == "left_anti":
        iv = iv.select(*keys, *SPAN)
    iv = iv.withColumn("__kind", F.lit("match"))
    if outer:
        gaps = _complement(iv, keys).withColumn("__kind", F.lit("gap"))
        # Rows of a known series find the mark; those of others find nothing at the widest level.
        mark = iv.select(*keys).distinct().withColumns(
            {START: F.lit(NEVER), END: F.lit(FOREVER), "__kind": F.lit("known")}
        )
        more = pinned(gaps.unionByName(mark))
        levels |= {b: max(n, levels.get(b, 1)) for b, n in _levels(more).items()} | {WIDEST_BITS: 1 << SHARE_BITS}
        iv = iv.unionByName(more, allowMissingColumns=True)
    if not levels:
        return rows.join(iv.drop("__kind", *keys), F.lit(False), "inner")
    spans = interval_cells(iv, levels).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        *[F.col(c).alias(f"__iv{c}") for c in ("__bits", "__cell", "__share")],
        "__kind",
        *[F.col(c).alias(f"__iv_{c}" if c in SPAN else c) for c in iv.columns if c not in keys and c != "__kind"],
    )
    hashable = [n for n, t in rows.dtypes if not t.startswith(("map", "variant"))]
    probes = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(n).alias("n")) for b, n in sorted(levels.items())])
    left = rows.withColumn("__probe", F.explode(probes)).select(
        *rows.columns,
        F.col("__probe.b").alias("__bits"),
        F.call_function("shiftright", F.col(ts), F.col("__probe.b")).alias("__cell"),
        F.pmod(F.xxhash64(*hashable), F.col("__probe.n")).cast("int").alias("__share"),
    )
    on = [left[k] == spans[f"__k_{k}"] for k in keys]
    on += [left[c] == spans[f"__iv{c}"] for c in ("__bits", "__cell", "__share")]
    on += [left[ts] >= spans[f"__iv_{START}"], left[ts] < spans[f"__iv_{END}"]]
    joined = left.join(spans, on, "left" if outer else "inner")
    if outer:
        alone = F.col("__kind").isNull() & (F.col("__bits") == WIDEST_BITS)
        joined = joined.filter((F.col("__kind") != "known") | alone)
    if how == "left_anti":
        joined = joined.filter(F.col("__kind").isNull() | (F.col("__kind") == "gap"))
    if how in ("left_semi", "left_anti"):
        return joined.select(*rows.columns)
    met = F.col("__kind") == "match"
    own = {f"__iv_{c}": F.when(met, F.col(f"__iv_{c}")) for c in SPAN} if outer else {}
    dropped = ["__bits", "__cell", "__share", "__kind", *[f"__k_{k}" for k in keys], *[f"__iv{c}" for c in ("__bits", "__cell", "__share")]]
    return joined.withColumns(own).drop(*dropped).withColumnsRenamed({f"__iv_{c}": c for c in SPAN})


def trim(rows: DataFrame, keep: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Only the rows inside the keep intervals."""
    return interval_join(rows, keep.select(*keys, *SPAN), keys, ts, "left_semi")


def keep_offsets(keep: DataFrame, keys: Sequence[str], blocks: Blocks | None = None) -> DataFrame:
    """Keep intervals with ``offset_us``: the kept time before each of them."""
    blocks = blocks or pick_blocks(keep, keys, START)
    length = F.col(END) - F.col(START)
    cut = blocks.assign(keep.select(*keys, *SPAN), keys, SPAN)
    cut = carry(cut, keys, blocks, {"len": F.sum(length)}, {"__kept_in": ("sum_before", "len")})
    kept = F.coalesce(F.sum(length).over(before(ordered(keys, blocks, SPAN))), F.lit(0))
    return cut.withColumn("offset_us", (kept + F.col("__kept_in")).cast("long")).drop(
        "__kept_in", *blocks.cols
    )


def retime(
    rows: DataFrame,
    keep: DataFrame,
    keys: Sequence[str],
    ts: str,
    out: str = "new_ts_us",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Trim, and close the removed gaps: ``out`` is the time on the shortened timeline."""
    placed = interval_join(rows, keep_offsets(keep, keys, blocks), keys, ts, "inner")
    return placed.withColumn(out, F.col(ts) - F.col(START) + F.col("offset_us")).drop(
        *SPAN, "offset_us"
    )


def shift_origin(
    df: DataFrame, offsets: DataFrame, keys: Sequence[str], columns: Sequence[str], sign: int = 1
) -> DataFrame:
    """Move time columns by each series' ``offset_us``; negative or missing ones count as 0."""
    moved = spread_join(df, offsets.select(*keys, F.col("offset_us").alias("__off")), keys, "left")
    off = F.greatest(F.lit(0), F.coalesce("__off", F.lit(0))) * sign
    return moved.withColumns({c: F.col(c) + off for c in columns}).drop("__off")


def resample(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    step_us: int,
    order: Sequence[str] | None = None,
    ends: DataFrame | None = None,
    blocks: Blocks | None = None,
    ticks_per_step: int = 1,
) -> DataFrame:
    """One row per tick ``k * step_us``, holding the last value at or before the tick.

    ``ticks_per_step`` divides the step for rates that are no whole number of
    microseconds; tick times are then rounded down.

    Every row is repeated for the ticks before its successor: once, many times or never.
    The last row of a series lasts until the series end, or for its own instant only.
    """
    if step_us <= 0:
        raise ValueError("step_us must be positive")
    order = list(order or [ts])
    blocks = blocks or pick_blocks(df, keys, ts)
    cut = blocks.assign(df.select(*keys, *dict.fromkeys([ts, *order, value])), keys, order)
    cut = carry(cut, keys, blocks, {"first": F.min(ts)}, {"__next_in": ("lead", "first")})
    nxt = F.coalesce(F.lead(ts).over(ordered(keys, blocks, order)), F.col("__next_in").cast("long"))
    cut = cut.withColumn("__next", nxt)
    until = F.coalesce("__next", F.col(ts) + 1)
    if ends is not None:
        limit = ends.select(*keys, F.col(END).alias("__limit"))
        cut = spread_join(cut, limit, keys, "left") if blocks.cols else cut.join(limit, list(keys), "left")
        until = F.coalesce("__next", "__limit", F.col(ts) + 1)
    step = F.lit(step_us)
    first = floor_div(F.col(ts) * ticks_per_step - 1, step) + 1
    last = floor_div(until * ticks_per_step - 1, step)
    held = cut.select(*keys, value, first.cast("long").alias("__a"), last.cast("long").alias("__b"))
    return range_rows(held, F.col("__a"), F.col("__b"), "tick").select(
        *keys, floor_div(F.col("tick") * step_us, F.lit(ticks_per_step)).alias("tick_us"), value
    )


def resample_rate(df: DataFrame, keys, ts: str, value: str, rate: str = "source", **more) -> DataFrame:
    """``resample`` to one of the named rates; "source" and unknown rates change nothing."""
    if rate not in RATES or rate == "source":
        return df
    return resample(df, keys, ts, value, SECOND, ticks_per_step=int(rate), **more)


def pad_or_trim(
    df: DataFrame,
    segments: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    step_us: int,
    order: Sequence[str],
    fill: float = 0.0,
) -> DataFrame:
    """Exactly ``length_us`` of evenly spaced rows for every segment (keys, ``length_us``).

    Cells without a row get ``fill``, rows past the length are cut; of several rows in
    one cell the last counts. Both sides meet on (segment, cell).
    """
    cell = floor_div(F.col(ts), F.lit(step_us))
    long = segments.filter(F.col("length_us") >= step_us)
    last = int_div(F.col("length_us"), F.lit(step_us)) - 1
    cells = range_rows(long, F.lit(0).cast("long"), last.cast("long"), "cell").select(*keys, "cell")
    filled = df.groupBy(*keys, cell.alias("cell")).agg(
        F.max_by(value, F.struct(*order)).alias(value)
    )
    return cells.join(filled, [*keys, "cell"], "left").withColumn(
        value, F.coalesce(value, F.lit(fill))
    )


def concat_parts(
    df: DataFrame,
    parts: DataFrame,
    keys: Sequence[str],
    part: str,
    ts: str,
    part_order: Sequence[str],
    blocks: Blocks | None = None,
) -> DataFrame:
    """Join parts end to end: ``new_ts_us`` is the part's offset plus the time in the part.

    ``parts`` holds keys, the part id, its ``length_us`` and the ordering columns.
    """
    blocks = blocks or pick_blocks(parts, keys)
    cut = blocks.assign(parts, keys, part_order)
    cut = carry(
        cut, keys, blocks, {"len": F.sum("length_us")}, {"__len_in": ("sum_before", "len")}
    )
    passed = F.coalesce(F.sum("length_us").over(before(ordered(keys, blocks, part_order))), F.lit(0))
    offsets = cut.select(*keys, part, (passed + F.col("__len_in")).cast("long").alias("__off"))
    return (
        spread_join(df, offsets, [*keys, part])
        .withColumn("new_ts_us", F.col(ts) + F.col("__off"))
        .drop("__off")
    )
