"""Telemetry of runs: progress, remaining time, throttling, stalls and memory limits."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullmap.plans.blocks import (
    BLOCK,
    SECOND,
    Blocks,
    before,
    carry,
    int_div,
    ordered,
    pick_blocks,
    spread_join,
)
from lullmap.plans.scratch import pinned, written

# Fixed values of the progress model.
EMA_ALPHA = 0.25
# Rows of one chunk of a linear recurrence at most.
CHUNK_ROWS = 1 << 16
ETA_MIN_FRACTION, TOTAL_ETA_MIN_FRACTION = 0.01, 0.02
THROTTLE_US = SECOND // 2
DOWNLOAD_SPAN, QUIET_SPAN_CACHED, QUIET_SPAN_LONG = 0.05, 0.10, 0.35
QUIET_SPANS = ((600.0, 0.25), (3600.0, 0.30))
QUIET_END_MAX, CUT_SHARE = 0.75, 0.9
# Fixed values of the watchdogs, in seconds, and of the memory guard.
CONNECT_S, NO_PROGRESS_S, CEILING_S = 300, 1800, 28_800
WARN_S, KILL_S = 120, 300
SOFT_SHARE, HARD_SHARE, RESERVE_MB = 0.80, 0.95, 2048.0


def monotone(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    initial: float = 0.0,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Drop samples below the highest one so far; equal ones stay."""
    blocks = blocks or pick_blocks(df, keys, order[0])
    cut = carry(
        blocks.assign(df, keys, order), keys, blocks, {"top": F.max(value)}, {"__top_in": ("max_before", "top")}
    )
    top = F.greatest(
        F.lit(initial),
        F.max(value).over(before(ordered(keys, blocks, order))),
        F.col("__top_in").cast("double"),
    )
    return (
        cut.withColumn("__top", top)
        .filter(F.col(value) >= F.col("__top"))
        .drop("__top", "__top_in", *blocks.cols)
    )


def ema(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    alpha: float = EMA_ALPHA,
    reset: Sequence[str] = (),
    out: str = "smoothed",
    blocks: Blocks | None = None,
) -> DataFrame:
    """Exponential moving average ``s += alpha * (raw - s)``, starting at the first sample.

    Negative samples count as 0 and a null repeats the last average. Averages are kept
    apart per ``reset`` value (such as a phase).

    The recurrence is linear, so it is summed rather than stepped through, see ``_recurrence``.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must lie in (0, 1]")
    group = [*keys, *reset]
    blocks = blocks or pick_blocks(df, group, order[0])
    sample = F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.col(value).cast("double")))

    # Index the non-null samples; a null shares the index of the sample before it.
    cut = blocks.assign(df, group, order)
    cut = carry(cut, group, blocks, {"n": F.count(value)}, {"__n_in": ("sum_before", "n")})
    seen = F.count(value).over(ordered(group, blocks, order).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("__i", (seen + F.col("__n_in")).cast("long") - 1)
    if blocks.cols:
        cut = cut.drop("__n_in", *blocks.cols)
    # The first sample has weight 1.
    weight = F.when(F.col("__i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    cut = _recurrence(cut.withColumn("__x", sample * weight), group, order, "__i", "__x", 1.0 - alpha, "__s")
    return cut.withColumn(out, F.when(F.col("__i") >= 0, F.col("__s"))).drop("__i", "__x", "__s", "__n_in")


def _recurrence(
    df: DataFrame, group: Sequence[str], order: Sequence[str], index: str, term: str, decay: float, out: str
) -> DataFrame:
    """Add ``out``: ``s = decay * s + term`` along a dense index; rows without a term repeat it.

    Rows are taken in chunks of ``width``, each with its own weighted sum. Where anything more
    than two chunks back weighs less than 1e-60, a chunk sees the two before it. Otherwise what
    the chunks hand on is a recurrence of its own, with a row for each chunk and a steeper decay.
    """
    size = 1 if decay == 0 else max(1, math.ceil(-30 * math.log(10) / math.log(decay)))
    width = min(size, CHUNK_ROWS)
    cut = df.withColumn("__chunk", int_div(F.greatest(F.lit(0), F.col(index)), F.lit(width)))
    cut = cut.withColumn("__r", F.col(index) - F.col("__chunk") * width)
    # In a chunk: decay^r * sum(term * decay^-r).
    r = F.col("__r").cast("double")
    scaled = F.col(term) if decay == 0 else F.col(term) * F.pow(F.lit(decay), -r)
    chunk = Window.partitionBy(*group, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("__own", F.pow(F.lit(decay), r) * F.sum(scaled).over(chunk))

    handed = cut.filter(F.col(term).isNotNull() & (F.col("__r") == width - 1)).select(
        *group, F.col("__chunk").alias("__i"), F.col("__own").alias("__h")
    )
    on = [*group, "__chunk"]
    later = lambda by, name, of: handed.select(*group, (F.col("__i") + by).alias("__chunk"), F.col(of).alias(name))
    if size <= width:
        joined = cut.join(later(1, "__h1", "__h"), on, "left").join(later(2, "__h2", "__h"), on, "left")
        brought = F.coalesce("__h1", F.lit(0.0)) + F.lit(decay**width) * F.coalesce("__h2", F.lit(0.0))
    else:
        handed = _recurrence(handed, group, ["__i"], "__i", "__h", decay**width, "__s")
        joined = cut.join(later(1, "__h1", "__s"), on, "left").withColumn("__h2", F.lit(None))
        brought = F.coalesce("__h1", F.lit(0.0))
    s = F.col("__own") + F.pow(F.lit(decay), r + 1) * brought
    return joined.withColumn(out, s).drop("__chunk", "__r", "__own", "__h1", "__h2")


def eta(
    df: DataFrame, keys: Sequence[str], ts: str, fraction: str, blocks: Blocks | None = None
) -> DataFrame:
    """Seconds elapsed since a run's first row, remaining, and in total; null while too early.

    ``ts`` is BIGINT microseconds.
    """
    blocks = blocks or pick_blocks(df, keys, ts)
    cut = blocks.assign(df, keys, [ts])
    timed = carry(cut, keys, blocks, {"first": F.min(ts)}, {"__first": ("min_all", "first")})
    f = F.col(fraction)
    elapsed = (F.col(ts) - F.col("__first")) / F.lit(1e6)
    estimate = lambda least: F.when(least, elapsed / F.when(least, f))
    return timed.withColumns(
        {
            "elapsed_s": elapsed,
            "eta_s": estimate(f > ETA_MIN_FRACTION) - elapsed,
            "total_s": estimate(f >= TOTAL_ETA_MIN_FRACTION),
        }
    ).drop("__first", *blocks.cols)


def overall_progress(df: DataFrame) -> DataFrame:
    """Map a phase's fraction to the progress of the whole run.

    Needs ``phase`` (download, quiet, cut, join), ``fraction``, ``is_downloaded``,
    ``cache_hit`` and ``duration_s``; adds ``overall``.
    """
    length = F.col("duration_s")
    quiet_span = F.when(F.col("cache_hit"), QUIET_SPAN_CACHED).when(
        length.isNull() | (length <= 0), QUIET_SPAN_LONG
    )
    for upto_s, span in QUIET_SPANS:
        quiet_span = quiet_span.when(length <= upto_s, span)
    quiet_span = quiet_span.otherwise(QUIET_SPAN_LONG)
    download_end = F.when(F.col("is_downloaded"), DOWNLOAD_SPAN).otherwise(0.0)
    quiet_end = F.least(F.lit(QUIET_END_MAX), download_end + quiet_span)
    cut_end = quiet_end + (F.lit(1.0) - quiet_end) * CUT_SHARE
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    phase = F.col("phase")
    return df.withColumn(
        "overall",
        F.when(phase == "download", download_end * f)
        .when(phase == "quiet", download_end + f * (quiet_end - download_end))
        .when(phase == "cut", quiet_end + f * (cut_end - quiet_end))
        .when(phase == "join", cut_end + f * (F.lit(1.0) - cut_end)),
    )


def _next_kept(t: np.ndarray, forced: np.ndarray, interval: int) -> np.ndarray:
    """Index of the row kept after each row, were that row kept; ``len(t)`` if none here."""
    due = np.maximum(np.searchsorted(t, t + interval, side="left"), np.arange(1, len(t) + 1))
    marks = np.append(np.flatnonzero(forced), len(t))
    return np.minimum(due, marks[np.searchsorted(marks, np.arange(len(t)), side="right")])


def _kept(t: np.ndarray, forced: np.ndarray, interval: int, last: float) -> np.ndarray:
    """Indexes of the rows kept after a row at ``last``."""
    marks = np.append(np.flatnonzero(forced), len(t))
    chosen, i = [], int(min(np.searchsorted(t, last + interval, side="left"), marks[0]))
    while i < len(t):
        chosen.append(i)
        due = max(i + 1, np.searchsorted(t, t[i] + interval, side="left"))
        i = int(min(due, marks[np.searchsorted(marks, i, side="right")]))
    return np.asarray(chosen, dtype=np.int64)


def throttle(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    interval_us: int = THROTTLE_US,
    forced: str | None = None,
    order: Sequence[str] | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Keep a row only when ``interval_us`` has passed since the last *kept* row.

    Forced rows are always kept. Which rows stay depends on the one kept before, so a cut
    series needs two rounds: every piece reports, for each row that could be its first
    kept one, which row it would keep last; following these reports from piece to piece
    gives each piece its true start. A piece reports only rows within ``interval_us`` of
    its beginning, so pieces are kept much wider than that.
    """
    order = list(order or [ts])
    blocks = blocks or pick_blocks(df, keys, ts, least_us=16 * interval_us)
    flag = F.coalesce(F.col(forced), F.lit(False)) if forced else F.lit(False)
    cut = blocks.assign(df.withColumn("__forced", flag), keys, order)
    group = [*keys, *blocks.cols]
    types = dict(cut.dtypes)
    of = lambda cols: ", ".join(f"`{c}` {types[c]}" for c in cols)
    kept_schema = of([c for c in cut.columns if c != "__forced"])

    def pieces(batch: pd.DataFrame) -> Iterator[tuple[tuple, int, int]]:
        """Piece id, first row and end of every piece in a batch of sorted rows."""
        ids = [batch[c].to_numpy() for c in group]
        turns = np.any([v[1:] != v[:-1] for v in ids], axis=0)
        starts = np.append(0, np.flatnonzero(turns) + 1)
        for a, b in zip(starts, np.append(starts[1:], len(batch))):
            yield tuple(v[a] for v in ids), a, b

    def kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk sorted rows batch by batch; only the last kept time crosses a batch."""
        open_piece, last = None, -math.inf
        for batch in batches:
            if batch.empty:
                continue
            t, marks = batch[ts].to_numpy(), batch["__forced"].to_numpy(dtype=bool)
            entry = batch["__last"].to_numpy()
            chosen = []
            for piece, a, b in pieces(batch):
                last = last if piece == open_piece else entry[a]
                open_piece = piece
                picked = a + _kept(t[a:b], marks[a:b], interval_us, last)
                if len(picked):
                    last = t[picked[-1]]
                    chosen.append(picked)
            rows = np.concatenate(chosen) if chosen else []
            yield batch.iloc[rows].drop(columns=["__forced", "__last"])

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*[F.col(c) for c in group]).sortWithinPartitions(*group, *order)

    if not blocks.cols:
        started = cut.withColumn("__last", F.lit(-math.inf))
        return in_order(started).mapInPandas(kept_rows, kept_schema)

    report_columns = [*group, "due", "kept", "marked"]

    def report(piece: tuple, parts: list[tuple[np.ndarray, np.ndarray]]) -> list:
        t, marks = (np.concatenate(arrays) for arrays in zip(*parts))
        n = len(t)
        follow = _next_kept(t, marks, interval_us)
        # Follow every chain to its last row here, doubling the stride each time.
        last = np.where(follow < n, follow, np.arange(n))
        while (last[last] != last).any():
            last = last[last]
        # Row i is kept first when due after row i - 1; with it goes the row kept last.
        reach = int(np.searchsorted(t, t[0] + interval_us, side="left"))
        first_mark = np.flatnonzero(marks)
        reach = min(n - 1, reach, first_mark[0] if len(first_mark) else n)
        return [*piece, t[: reach + 1].tolist(), t[last[: reach + 1]].tolist(), bool(marks[reach])]

    def reports(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_piece, parts = None, []
        for batch in batches:
            if batch.empty:
                continue
            t, marks = batch[ts].to_numpy(), batch["__forced"].to_numpy(dtype=bool)
            done = []
            for piece, a, b in pieces(batch):
                if piece != open_piece and parts:
                    done.append(report(open_piece, parts))
                    parts = []
                open_piece = piece
                parts.append((t[a:b], marks[a:b]))
            yield pd.DataFrame(done, columns=report_columns)
        if parts:
            yield pd.DataFrame([report(open_piece, parts)], columns=report_columns)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        last, starts = -math.inf, []
        rows = rows.sort_values(BLOCK)
        for due, kept, marked in zip(rows["due"], rows["kept"], rows["marked"]):
            starts.append(last)
            i = int(np.searchsorted(np.asarray(due), last + interval_us, side="left"))
            if i >= len(due) and marked:
                i = len(due) - 1
            if i < len(due):
                last = kept[i]
        out = rows[group].copy()
        out["__last"] = starts
        return out

    slim = cut.select(*dict.fromkeys([*group, ts, *order, "__forced"]))
    told = in_order(slim).mapInPandas(
        reports, f"{of(group)}, due array<bigint>, kept array<bigint>, marked boolean"
    )
    starts = told.groupBy(*keys).applyInPandas(chain, f"{of(group)}, `__last` double")
    return in_order(cut.join(starts, group)).mapInPandas(kept_rows, kept_schema).drop(*blocks.cols)


def stall_report(
    events: DataFrame,
    runs: DataFrame,
    keys: Sequence[str],
    ts: str,
    connect_s: float = CONNECT_S,
    no_progress_s: float = NO_PROGRESS_S,
    ceiling_s: float = CEILING_S,
    warn_s: float = WARN_S,
    kill_s: float = KILL_S,
    blocks: Blocks | None = None,
) -> DataFrame:
    """First watchdog breach, stall warnings and kill time of every run.

    ``runs`` holds keys, ``start_us`` and ``seen_us`` (observed until); ``ts`` is BIGINT
    microseconds. Silences are measured from the run start to the first event, between
    events, and from the last event to ``seen_us``; limits are exceeded strictly. Events
    before the start of their run, or of no run, do not count.
    """
    begun = runs.select(*keys, F.col("start_us").alias("__from"))
    events = spread_join(events.select(*keys, ts), begun, keys).filter(F.col(ts) >= F.col("__from")).drop("__from")
    blocks = blocks or pick_blocks(events, keys, ts)
    cut = blocks.assign(events.select(*keys, ts), keys, [ts])
    cut = carry(cut, keys, blocks, {"first": F.min(ts)}, {"__next_in": ("lead", "first")})
    nxt = F.coalesce(F.lead(ts).over(ordered(keys, blocks, [ts])), F.col("__next_in").cast("long"))
    between = cut.select(*keys, F.col(ts).alias("from_us"), nxt.alias("to_us"), F.lit(False).alias("first"))
    firsts = events.groupBy(*keys).agg(F.min(ts).alias("__first"))
    opening = runs.join(firsts, list(keys), "left").select(
        *keys,
        F.col("start_us").alias("from_us"),
        F.col("__first").alias("to_us"),
        F.lit(True).alias("first"),
    )
    us = lambda seconds: F.lit(round(seconds * 1e6))
    start, from_us = F.col("start_us"), F.col("from_us")
    bounded = (
        spread_join(between.unionByName(opening), runs.select(*keys, "start_us", "seen_us"), keys)
        .withColumn("to_us", F.coalesce("to_us", "seen_us"))
    )
    silent = F.col("to_us") - from_us
    over = F.col("to_us") - start > us(ceiling_s)
    quiet_at = F.when(F.col("first"), from_us + us(connect_s)).otherwise(from_us + us(no_progress_s))
    quiet = F.when(F.col("first"), silent > us(connect_s)).otherwise(silent > us(no_progress_s))
    ceiling_at = start + us(ceiling_s)
    # Whichever limit is reached first within a silence; the ceiling wins a tie.
    at = F.least(F.when(over, F.greatest(ceiling_at, from_us)), F.when(quiet, quiet_at))
    kind = (
        F.when(over & (~quiet | (F.greatest(ceiling_at, from_us) <= quiet_at)), "ceiling")
        .when(F.col("first") & quiet, "connect")
        .when(quiet, "no_progress")
    )
    killed = F.min(F.when(silent > us(kill_s), from_us + us(kill_s)))
    found = bounded.groupBy(*keys).agg(
        F.min(at).alias("breach_us"),
        F.min_by(kind, F.when(at.isNotNull(), F.struct(at, kind))).alias("breach"),
        F.count_if(silent > us(warn_s)).alias("warnings"),
        killed.alias("kill_us"),
        F.max(silent).alias("longest_us"),
    )
    return runs.select(*keys).join(found, list(keys), "left")


def telemetry_limits(
    samples: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    used: str,
    available: str,
    limit: float | None,
    reserve: float = RESERVE_MB,
    soft: float = SOFT_SHARE,
    hard: float = HARD_SHARE,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Peak use, first soft and hard crossing and reserve breach of every run.

    A run's samples end at the second null in a row or at the hard crossing. The peak
    includes the hard sample; soft crossing and reserve breach come from earlier,
    non-null samples only.
    """
    blocks = blocks or pick_blocks(samples, keys, order[0])
    at = F.struct(*order)
    cut = blocks.assign(samples.select(*keys, *dict.fromkeys([*order, used, available])), keys, order)
    gone = F.col(used).isNull()
    cut = carry(cut, keys, blocks, {"last": F.max_by(gone, at)}, {"__gone_in": ("lag", "last")})
    was_gone = F.coalesce(
        F.lag(gone).over(ordered(keys, blocks, order)), F.col("__gone_in").cast("boolean"), F.lit(False)
    )
    capped = limit is not None and limit > 0
    too_much = F.col(used) >= limit * hard if capped else F.lit(False)
    flagged = cut.withColumns(
        {"__stop": (gone & was_gone) | F.coalesce(too_much, F.lit(False)), "__at": at}
    ).drop("__gone_in")
    stops = F.min(F.when(F.col("__stop"), F.col("__at")))
    live = carry(flagged, keys, blocks, {"stop": stops}, {"__until": ("min_all", "stop")})
    u, until = F.col(used), F.col("__until")
    inside = until.isNull() | (F.col("__at") < until)
    ending = inside | (F.col("__at") == until)
    softly = u >= limit * soft if capped else F.lit(False)
    first_col = F.col(order[0])
    return live.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(ending, u)), F.lit(0.0)).alias("peak"),
        F.min(F.when(inside & softly, first_col)).alias("soft_at"),
        F.min(F.when(ending & too_much, first_col)).alias("hard_at"),
        F.coalesce(
            F.bool_or(inside & u.isNotNull() & (F.col(available) < reserve)), F.lit(False)
        ).alias("reserve_breached"),
    )


def ancestors(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """Every (node, ancestor) pair of a forest, each node being its own ancestor too.

    ``edges`` has one row per node with its parent, null at the roots. Paths are doubled,
    so a depth of n takes log2(n) rounds; each round is written to the checkpoint folder,
    because it is used twice in the next. Edges that still lead on after as many rounds as
    the longest path can need run in a circle, which is an error.
    """
    jump = edges.filter(F.col(parent).isNotNull()).select(
        F.col(node).alias("from_node"), F.col(parent).alias("to_node")
    )
    pairs = edges.select(F.col(node).alias("node"), F.col(node).alias("ancestor"))
    rounds = max(1, edges.count()).bit_length() + 1
    while not jump.isEmpty():
        if rounds == 0:
            looped = [r["from_node"] for r in jump.select("from_node").distinct().limit(5).collect()]
            raise ValueError(f"nodes whose parents run in a circle, such as {looped}")
        rounds -= 1
        further = pairs.join(jump, F.col("ancestor") == F.col("from_node")).select(
            "node", F.col("to_node").alias("ancestor")
        )
        pairs = pinned(pairs.unionByName(further))
        twice = jump.select(F.col("from_node").alias("to_node"), F.col("to_node").alias("end"))
        jump = pinned(jump.join(twice, "to_node").select("from_node", F.col("end").alias("to_node")))
    return pairs


# Live nodes of a tree that one task finishes by itself.
FINISHED_AT_ONCE = 50_000


def _held(df: DataFrame) -> DataFrame:
    return written(df, "tree")


def _contracted(live: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round on (node, parent): leaves (node, parent), spliced (node, child, parent) and what stays.

    A node of one child leaves a chain when its hash exceeds those of both neighbours, so no
    two neighbours go at once and about a third of a chain does. One whose child is a leaf
    stays, as it takes up the leaf's sum.
    """
    kids = live.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node"))
    kids = kids.agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("child"))
    known = _held(live.join(kids, "node", "left"))
    leaves = known.filter("n IS NULL").select("node", "parent")
    h = F.xxhash64
    lone = known.filter("n = 1 AND parent IS NOT NULL AND parent <> node")
    lone = lone.filter((h("node") > h("parent")) & (h("node") > h("child"))).select("node", "child", "parent")
    above = leaves.filter("parent IS NOT NULL").select(F.col("parent").alias("node")).distinct()
    spliced = _held(lone.join(above, "node", "left_anti"))
    stays = known.filter("n IS NOT NULL").select("node", "parent").join(spliced.select("node"), "node", "left_anti")
    moved = spliced.select(F.col("child").alias("node"), F.col("parent").alias("__up"))
    stays = stays.join(moved, "node", "left").select("node", F.coalesce("__up", "parent").alias("parent"))
    return leaves, spliced, stays


def _circle(nodes: list) -> ValueError:
    return ValueError(f"nodes whose parents run in a circle, such as {sorted(nodes)[:5]}")


def _finished(sums: DataFrame, live: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of the last live nodes, few enough for a task, apart for every ``by``."""
    parent = {r["node"]: r["parent"] for r in live.collect()}
    left = dict.fromkeys(parent, 0)
    for p in parent.values():
        if p is not None:
            left[p] += 1
    order = [n for n, k in left.items() if not k]
    for n in order:
        p = parent[n]
        if p is not None:
            left[p] -= 1
            if not left[p]:
                order.append(p)
    if len(order) < len(parent):
        raise _circle([n for n, k in left.items() if k])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip(rows["node"], rows["total"]))
        for n in order:
            if n in total and parent[n] is not None:
                total[parent[n]] = total[parent[n]] + total[n] if parent[n] in total else total[n]
        out = pd.DataFrame({"node": list(total), "total": list(total.values())})
        for c in by:
            out[c] = rows[c].iloc[0]
        return out[list(rows.columns)]

    return sums.groupBy(*by).applyInPandas(add, sums.schema)


def tree_total(
    samples: DataFrame,
    edges: DataFrame,
    node: str,
    parent: str,
    metric: str,
    by: Sequence[str] = (),
    finished_at_once: int = FINISHED_AT_ONCE,
) -> DataFrame:
    """Sum of a metric over each node and all its descendants.

    Members without a sample are skipped; a node without a sample of its own gets null. A node
    has one parent at most; several, or parents that run in a circle, are errors.

    The tree is contracted in rounds of as many rows as nodes are left: leaves fold their sums
    into their parents, and chains are thinned by nodes whose total is that of their only
    child and their own. At most ``finished_at_once`` nodes are then summed up by one task for
    each ``by``, and the thinned-out nodes get their totals in reverse order.
    """
    tree = edges.select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct()
    above = tree.select(F.col("parent").alias("node")).filter("node IS NOT NULL")
    tree = tree.unionByName(above, allowMissingColumns=True).groupBy("node").agg(
        F.max("parent").alias("parent"), F.count_distinct("parent").alias("n")
    )
    live = _held(tree)
    torn = [r["node"] for r in live.filter("n > 1").limit(5).collect()]
    if torn:
        raise ValueError(f"nodes of several parents, such as {torn}")
    live = live.select("node", "parent")
    measured = samples.filter(F.col(metric).isNotNull()).withColumnRenamed(node, "node")
    measured = measured.join(live.select("node"), "node", "left_semi")
    own = _held(measured.groupBy("node", *by).agg(F.sum(metric).alias("total")))
    sums, done, rounds = own, [], []
    left = live.count()
    while left > finished_at_once:
        leaves, spliced, stays = _contracted(live)
        live, before = _held(stays), left
        left = live.count()
        if left == before:
            raise _circle([r["node"] for r in live.limit(5).collect()])
        ended = _held(sums.join(leaves, "node"))
        done.append(ended.select(sums.columns))
        kept = _held(sums.join(spliced.select("node", "parent"), "node"))
        rounds.append((spliced.select("node", "child"), kept.select(sums.columns)))
        # The sums of both go to the parent; what is below a spliced node comes to it later.
        up = ended.unionByName(kept).filter("parent IS NOT NULL").drop("node").withColumnRenamed("parent", "node")
        stay = sums.join(live.select("node"), "node", "left_semi").unionByName(up.select(sums.columns))
        sums = _held(stay.groupBy("node", *by).agg(F.sum("total").cast(own.schema["total"].dataType).alias("total")))
    done.append(_held(_finished(sums, live, by)))
    for spliced, kept in reversed(rounds):
        totals = functools.reduce(DataFrame.unionByName, done)
        below = totals.withColumnRenamed("node", "child").join(spliced, "child").select(kept.columns)
        both = kept.unionByName(below).groupBy("node", *by)
        done.append(_held(both.agg(F.sum("total").cast(own.schema["total"].dataType).alias("total"))))
    totals = functools.reduce(DataFrame.unionByName, done)
    mark = own.select("node", *by, F.lit(True).alias("__own"))
    on = [totals["node"] == mark["node"], *[totals[c].eqNullSafe(mark[c]) for c in by]]
    return totals.join(mark, on, "left").select(
        totals["node"].alias(node), *[totals[c] for c in by], F.when(F.col("__own"), F.col("total")).alias("total")
    )
