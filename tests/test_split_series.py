"""Cutting a series must not change any result."""

import random

import pytest
import spec
from pyspark.sql import functions as F

from lullmap.bindings.common import HOUR, ORDER, USER, samples, user_ends
from lullmap.operators import apply, envelope, quality, summary, sweep, telemetry
from lullmap.operators.intervals import apply_margin, cut_plan
from lullmap.operators.quiet import detect_quiet, plan_cut
from lullmap.plans.blocks import RangeBlocks, TimeBlocks, WholeSeries, positions
from lullmap.sources import lines

CUTS = [TimeBlocks(60 * HOUR), RangeBlocks(7)]


@pytest.fixture(scope="module")
def rows(spark, sf):
    """One series holds a third of all rows."""
    events = samples(spark, sf)
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return events.withColumn("user_id", hot.cast("long")).cache()


def rounded(df):
    rows = df.select(*sorted(df.columns)).collect()
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in rows), key=repr)


def same(make):
    whole = rounded(make(WholeSeries()))
    assert whole
    for cut in CUTS:
        assert rounded(make(cut)) == whole, cut


def test_positions(rows):
    same(lambda b: positions(rows.select("user_id", "t", "event_id"), USER, ORDER, b))


def test_envelope(rows):
    same(lambda b: envelope.envelope(rows, USER, ORDER, "value", 16, b))


def test_monotone(rows):
    same(lambda b: telemetry.monotone(rows, USER, ORDER, "value", blocks=b))


def test_eta(rows):
    same(lambda b: telemetry.eta(rows.withColumn("f", F.col("value") / 500), USER, "t", "f", b))


def test_ema(rows):
    gappy = rows.withColumn("raw", F.when(F.col("event_id") % 5 != 0, F.col("value") - 30))
    same(lambda b: telemetry.ema(gappy, USER, ORDER, "raw", 0.1, blocks=b))


@pytest.mark.parametrize("hours", [1, 9, 40])
def test_throttle(rows, hours):
    flagged = rows.withColumn("f", (F.col("event_type") == "error") & (F.col("event_id") % 7 == 0))
    same(lambda b: telemetry.throttle(flagged, USER, "t", hours * HOUR, "f", ORDER, b))


def test_stall_report(rows):
    runs = user_ends(rows).withColumns({"start_us": F.lit(HOUR), "seen_us": F.col("end_us") + 30 * HOUR})
    limits = [h * 3600.0 for h in (2, 20, 500, 5, 9)]
    same(lambda b: telemetry.stall_report(rows.filter(F.col("t") > HOUR), runs, USER, "t", *limits, blocks=b))


def test_telemetry_limits(rows):
    used = rows.withColumns(
        {"u": F.when(F.col("event_id") % 5 < 3, F.col("value")), "av": 80 - F.col("value")}
    )
    same(lambda b: telemetry.telemetry_limits(used, USER, ORDER, "u", "av", 260.0, 5.0, blocks=b))


def test_resample(rows):
    ends = user_ends(rows)
    same(lambda b: apply.resample(rows, USER, "t", "value", 7 * HOUR, ORDER, ends, b))
    same(lambda b: apply.resample(rows, USER, "t", "value", 7 * HOUR, ORDER, None, b))


def test_retime(rows):
    keep = rows.filter(F.col("event_id") % 4 == 0).select(
        "user_id", F.col("t").alias("start_us"), (F.col("t") + 1000).alias("end_us")
    )
    same(lambda b: apply.retime(rows, keep, USER, "t", blocks=b))


def test_starts_agree(rows):
    clicks = rows.filter(F.col("event_type") == "click").withColumnRenamed("t", "start_us")
    moved = clicks.withColumn("start_us", F.col("start_us") + F.col("user_id") % 3 * 40_000)
    same(lambda b: quality.starts_agree(clicks, moved, USER, rows, blocks=b))


def test_sweep(rows):
    grid = [(30.0, 9 * HOUR, HOUR), (60.0, 9 * HOUR, -HOUR), (60.0, 20 * HOUR, 0), (90.0, 0, HOUR)]
    same(lambda b: sweep.parameter_sweep(rows, USER, "t", "value", grid, user_ends(rows), order=ORDER, blocks=b))


def test_plan(rows):
    ends = user_ends(rows)

    def plan(b):
        quiet = detect_quiet(rows, USER, "t", "value", 60.0, 9 * HOUR, ends, ORDER, b)
        cut = apply_margin(quiet, USER, -HOUR, ends, b)
        return cut_plan(cut, ends, USER, 2 * HOUR, b)

    same(plan)


def test_median(rows):
    for b in (WholeSeries(), RangeBlocks(6)):
        assert rounded(summary.exact_median(rows, ["event_type"], "value", b))
    got = {r["event_type"]: r["value"] for r in summary.exact_median(rows, ["event_type"], "value").collect()}
    want = {r["event_type"]: r["m"] for r in rows.groupBy("event_type").agg(F.median("value").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_quiet_log(rows):
    line = F.when(F.col("event_id") % 3 < 2, F.format_string("silence_start: %d", "event_id")).otherwise(
        F.format_string("silence_end: %d", "event_id")
    )
    log = rows.withColumn("line", line)
    ends = user_ends(rows)
    same(lambda b: lines.parse_quiet_log(log, USER, ORDER, "line", ends, b))


@pytest.mark.parametrize("cut", [WholeSeries(), TimeBlocks(25), RangeBlocks(5)], ids=str)
def test_throttle_and_ema_against_spec(spark, cut):
    rng = random.Random(11)
    data = {
        k: [(t, rng.random() < 0.1, rng.choice([None, -1.0, 3.0, 9.5])) for t in sorted(rng.sample(range(200), 60))]
        for k in range(20)
    }
    df = spark.createDataFrame(
        [(k, t, f, v) for k, r in data.items() for t, f, v in r], "k int, t bigint, f boolean, v double"
    )
    got = {}
    for r in telemetry.throttle(df, ["k"], "t", 11, "f", blocks=cut).collect():
        got.setdefault(r["k"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {
        k: spec.throttle([(t, f) for t, f, _ in r], 11) for k, r in data.items()
    }
    smooth = {(r["k"], r["t"]): r["smoothed"] for r in telemetry.ema(df, ["k"], ["t"], "v", 0.25, blocks=cut).collect()}
    for k, r in data.items():
        for (t, _, _), want in zip(r, spec.ema([v for _, _, v in r], 0.25)):
            assert smooth[(k, t)] == (None if want is None else pytest.approx(want, abs=1e-9))


@pytest.mark.parametrize("alpha", [0.01, 0.5, 0.99, 1.0])
def test_ema_weights(spark, alpha):
    rng = random.Random(5)
    values = [rng.random() * 10 for _ in range(3000)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "k int, t bigint, v double")
    got = {r["t"]: r["smoothed"] for r in telemetry.ema(df, ["k"], ["t"], "v", alpha, blocks=WholeSeries()).collect()}
    for i, want in enumerate(spec.ema(values, alpha)):
        assert got[i] == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("cut", CUTS)
def test_split_chain(spark, rows, cut):
    """Detection, margin, plan and new times of split rows: same result, and few exchanges."""
    ends = user_ends(rows)

    def chain(blocks):
        plan, own = plan_cut(rows, USER, "t", "value", 60.0, HOUR, HOUR // 2, ends, order=ORDER, blocks=blocks)
        kept = plan.filter("part = 'keep'").drop("part")
        return apply.retime(rows, kept, USER, "t", blocks=own)

    assert rounded(chain(cut)) == rounded(chain(WholeSeries()))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Reused" not in line for line in plan.split("\n"))


def test_exchanges_of_the_split_chain(spark, rows):
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        ends = user_ends(rows)
        quiet = detect_quiet(rows, USER, "t", "value", 60.0, HOUR, ends, ORDER, TimeBlocks(60 * HOUR))
        # Rows once, edge runs once, runs and ends to meet.
        assert exchanges(quiet) <= 4
        plan, own = plan_cut(rows, USER, "t", "value", 60.0, HOUR, HOUR // 2, ends, order=ORDER, blocks=TimeBlocks(60 * HOUR))
        assert own == WholeSeries() and exchanges(plan) <= 4
        kept = plan.filter("part = 'keep'").drop("part")
        assert exchanges(apply.retime(rows, kept, USER, "t", blocks=own)) <= 7
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("alpha", [0.3, 0.02, 0.0005])
def test_ema_of_small_chunks(spark, monkeypatch, alpha):
    """Chunks shorter than the memory of the average hand on what all before them say."""
    monkeypatch.setattr(telemetry, "CHUNK_ROWS", 8)
    rng = random.Random(1)
    raw = [rng.choice([None, rng.uniform(0, 100)]) for _ in range(700)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(raw)], "k int, at long, v double").repartition(5)
    got = {r["at"]: r["smoothed"] for r in telemetry.ema(df, ["k"], ["at"], "v", alpha, blocks=WholeSeries()).collect()}
    s = None
    for i, v in enumerate(raw):
        if v is not None:
            s = v if s is None else s + alpha * (v - s)
        assert got[i] == (None if s is None else pytest.approx(s, rel=1e-9)), i
