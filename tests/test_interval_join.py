"""Rows against intervals of any length, by cells of measured width."""

import random

import pytest
from pyspark.sql import functions as F

from lullmap.operators import apply
from lullmap.plans import blocks

SECOND, YEAR = 1_000_000, 365 * 86_400 * 1_000_000
KEYS = ["k"]


@pytest.fixture(scope="module")
def tables(spark):
    """One series holds most rows, one has no interval, one interval covers a year, most a second."""
    rng = random.Random(4)
    rows = [(1 if i % 3 else rng.randrange(1, 5), i, rng.randrange(-YEAR // 4, YEAR + YEAR // 4)) for i in range(3000)]
    rows += [(1, 9000 + i, t) for i, t in enumerate([0, YEAR - 1, YEAR, -1, None, 10 * SECOND])] + [(9, 9999, 5)]
    iv = [(1, "year", 0, YEAR), (2, "empty", 50, 50), (2, "all", -YEAR, 2 * YEAR)]
    for i in range(800):
        k, start = rng.choice([1, 3]), rng.randrange(-YEAR // 8, YEAR)
        iv.append((k, f"s{i}", start, start + rng.choice([1, SECOND, SECOND, 3600 * SECOND, 86_400 * SECOND])))
    near = rows[:200]
    iv += [(k, f"n{i}", t, t + SECOND) for k, i, t in near if k != 4]
    df = spark.createDataFrame(rows, "k long, id long, t long").repartition(3)
    return rows, iv, df, spark.createDataFrame(iv, "k long, name string, start_us long, end_us long").repartition(2)


def brute(rows, iv):
    return {(k, i, t): sorted(n for q, n, s, e in iv if q == k and t is not None and s <= t < e) for k, i, t in rows}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_as_plain_comparison(tables, how):
    rows, iv, df, spans = tables
    want = brute(rows, iv)
    got = apply.interval_join(df, spans, KEYS, "t", how).collect()
    if how in ("left_semi", "left_anti"):
        assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r, names in want.items() if bool(names) == (how == "left_semi"))
        return
    pairs = sorted((repr((r.k, r.id, r.t)), r.name or "") for r in got)
    assert pairs == sorted((repr(r), n) for r, names in want.items() for n in (names or [""] if how == "left" else names))
    ends = {n: (s, e) for _, n, s, e in iv} | {None: (None, None)}
    assert all((r.start_us, r.end_us) == ends[r.name] for r in got)


def test_copies_of_an_interval(tables):
    """At most two cells, and shares only where few intervals are as wide: below 2 * log2 of the length."""
    _, iv, _, spans = tables
    spans = spans.filter("start_us < end_us")
    levels = apply._levels(spans)
    cells = {r.name: r["count"] for r in apply.interval_cells(spans, levels).groupBy("name").count().collect()}
    length = {n: e - s for _, n, s, e in iv}
    assert cells["year"] <= 2 * length["year"].bit_length()
    assert all(c <= 2 for n, c in cells.items() if length[n] <= 3600 * SECOND)


def test_rows_of_one_cell_are_dealt(spark):
    """A year-long interval over a hot series: its rows meet it in many groups, none with over a sixth of them."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 1_500_000_000).alias("t"), "id")
    spans = spark.createDataFrame([(1, 0, YEAR)], "k int, start_us long, end_us long")
    levels = apply._levels(spans)
    assert max(levels.values()) >= 16
    share = F.pmod(F.xxhash64("k", "t", "id"), F.lit(max(levels.values())))
    assert df.groupBy(share.alias("s")).count().agg(F.max("count")).first()[0] < 20_000 / 6
    assert apply.interval_join(df, spans, KEYS, "t").count() == 20_000


@pytest.mark.parametrize("how,count", [("inner", 0), ("left", 2), ("left_semi", 0), ("left_anti", 2)])
def test_without_intervals(spark, how, count):
    df = spark.createDataFrame([(1, 5), (2, None)], "k long, t long")
    none = spark.createDataFrame([(1, 7, 7)], "k long, start_us long, end_us long")
    got = apply.interval_join(df, none, KEYS, "t", how)
    assert got.count() == count and set(got.columns) >= {"k", "t"}


def test_left_join_keeps_gaps_of_split_intervals(spark, tables, monkeypatch):
    """Intervals of a series over several pieces leave the same gaps."""
    rows, iv, df, spans = tables
    monkeypatch.setattr(apply, "pick_blocks", lambda *a: blocks.TimeBlocks(30 * 86_400 * SECOND))
    got = apply.interval_join(df, spans, KEYS, "t", "left_anti").collect()
    want = brute(rows, iv)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r, names in want.items() if not names)
