import random

import pytest
from pyspark.sql import functions as F

from lullmap.operators import quality as q
from lullmap.operators import summary, telemetry

S = 1_000_000


def test_completeness(spark):
    df = spark.createDataFrame(
        [(6000, 100.0, 60.0), (1140, 100.0, 60.0), (1140, 100.0, None), (None, 100.0, 60.0), (10, 0.0, 60.0)],
        "rows bigint, seconds double, rate double",
    )
    verdict = q.completeness_verdict(F.col("rows"), F.col("seconds"), F.col("rate"))
    assert [r["v"] for r in df.select(verdict.alias("v")).collect()] == ["pass", "fail", "skipped", "skipped", "skipped"]


@pytest.mark.parametrize(
    "expected, actual, ok",
    [(0.8, 0.1, False), (0.8, 0.75, True), (300.0, 299.2, True), (300.0, 298.8, False), (10.0, None, False), (None, 5.0, False)],
)
def test_duration_ok(spark, expected, actual, ok):
    df = spark.createDataFrame([(expected, actual)], "expected_s double, actual_s double")
    assert q.duration_ok(df).first()["duration_ok"] is ok


@pytest.mark.parametrize(
    "video, audio, ok",
    [
        ((0.533, 2.5, None), (1.112, 1.968, None), True),
        ((0.0, 12.0, None), (0.0, 0.1, None), False),
        ((None, 12.0, None), (0.0, 12.1, None), True),
        ((None, None, 12.0), (None, 3.0, 12.1), True),
        ((None, None, 12.0), (None, None, 0.1), False),
        ((None, None, None), (None, None, 12.0), False),
        ((None, None, 0.0), (None, None, 0.0), False),
        ((0.0, 3600.0, None), (0.0, 3597.9, None), False),
        ((0.0, 3600.0, None), (0.0, 3598.1, None), True),
    ],
)
def test_ends_agree(spark, video, audio, ok):
    df = spark.createDataFrame(
        [(1, "video", *video), (1, "audio", *audio)],
        "part int, kind string, start_s double, duration_s double, measured_s double",
    )
    assert q.ends_agree(df, ["part"]).first()["agree"] is ok


def test_reusable_names_the_first_reason(spark):
    parts = spark.createDataFrame(
        [
            (1, 10, 10.0, 10.0, 600, 60.0),
            (2, 5000, 10.0, 5.0, 600, 60.0),
            (3, 5000, 10.0, 10.0, 100, 60.0),
            (4, 5000, 10.0, 10.0, 600, None),
            (5, None, 10.0, 10.0, 600, 60.0),
        ],
        "part int, size bigint, expected_s double, actual_s double, rows bigint, rate double",
    )
    got = {r["part"]: r["reason"] for r in q.reusable_parts(parts, None, ["part"]).collect()}
    assert got == {1: "size", 2: "duration", 3: "completeness", 4: None, 5: "size"}


@pytest.mark.parametrize(
    "a, b, ok",
    [
        ([5.0, 30.0], [5.03, 30.01], True),
        ([5.0, 30.0], [7.0, 32.0], False),
        ([5.0, 30.0], [5.0], False),
        ([], [], True),
    ],
)
def test_starts_agree(spark, a, b, ok):
    side = lambda v: spark.createDataFrame([(1, round(s * S)) for s in v], "k int, start_us bigint")
    series = spark.createDataFrame([(1,)], "k int")
    assert q.starts_agree(side(a), side(b), ["k"], series).first()["agree"] is ok


def test_starts_agree_drops_the_padded_tail(spark):
    side = lambda v: spark.createDataFrame([(1, s * S) for s in v], "k int, start_us bigint")
    check = lambda pad: q.starts_agree(side([5, 59]), side([5]), ["k"], horizon_us=60 * S, pad_us=pad * S).first()
    assert check(2)["agree"] and not check(0)["agree"] and not check(60)["agree"]


def test_manifest_diff(spark):
    schema = "id int, method string, size bigint, keep_segments array<struct<start: double, end: double>>"
    now = spark.createDataFrame(
        [(i, "batch", 10, [(0.0, 1.0), (2.0, 3.0)]) for i in range(6)] + [(6, "batch", 10, None)], schema
    )
    before = spark.createDataFrame(
        [
            (0, "batch", 10, [(0.0, 1.0), (2.0, 3.0 + 1e-10)]),
            (1, "segment", 11, [(0.0, 1.0)]),
            (2, "batch", None, [(0.0, 1.0), (2.0, 3.0)]),
            (3, "batch", 10, [(0.0, 1.0)]),
            (4, "batch", 10, [(0.0, 1.0), (2.0, 3.1)]),
            (6, "batch", 10, []),
        ],
        schema,
    )
    got = {r["id"]: (r["status"], r["changed_field"]) for r in q.manifest_diff(now, before, ["id"], ["method"], ["size"]).collect()}
    assert got == {
        0: ("fresh", None),
        1: ("changed", "method"),
        2: ("changed", "size"),
        3: ("changed", "keep_segments"),
        4: ("changed", "keep_segments"),
        5: ("missing", None),
        6: ("fresh", None),
    }


def test_validate_rows(spark):
    rules = {
        "mode": {"kind": "enum", "valid": ["a", "b"]},
        "n": {"kind": "int", "min": 1, "max": 9},
        "limit": {"kind": "auto_or_int", "min": 0},
        "on": {"kind": "bool"},
        "note": {"kind": "str"},
    }
    df = spark.createDataFrame(
        [
            ("a", "3", "auto", "true", "x", 1, 2),
            ("c", "3.0", "AUTO", "yes", None, 1, 2),
            ("b", "1.9", "7.5", "false", "x", 3, 2),
            ("b", "nan", "-1", "FALSE", "", 1, 2),
            (None, "10", "inf", None, "x", 2, 2),
        ],
        "mode string, n string, limit string, on string, note string, warn int, kill int",
    )
    good, bad = q.split_valid(q.validate_rows(df, rules, [("warn", "kill")]))
    assert good.count() == 1 and "errors" not in good.columns
    reasons = [{e.split(":")[0] for e in r["errors"]} for r in bad.collect()]
    assert reasons == [{"mode", "on", "note"}, {"n", "limit", "warn"}, {"n", "limit"}, {"mode", "n", "limit", "on", "warn"}]


def test_space_estimate(spark):
    df = spark.createDataFrame(
        [("segment", 1000, 10.0, 5.0), ("batch", 1000, None, 5.0), ("cut_then_encode", 0, 10.0, 5.0)],
        "method string, size_bytes bigint, src_s double, keep_s double",
    )
    head = 512 << 20
    got = [(r["typical_bytes"] - head, r["worst_bytes"] - head) for r in summary.space_estimate(df).collect()]
    assert got == [(500, 1250), (1200, 2000), (0, 0)]


def test_stalls(spark):
    events = spark.createDataFrame(
        [(1, 10 * S), (1, 200 * S), (2, 400 * S), (3, 10 * S), (3, 2000 * S), (5, 300 * S)], "run int, t bigint"
    )
    runs = spark.createDataFrame(
        [(1, 0, 250 * S), (2, 0, 500 * S), (3, 0, 2500 * S), (4, 0, 301 * S), (5, 0, 300 * S)],
        "run int, start_us bigint, seen_us bigint",
    )
    got = {r["run"]: (r["breach"], r["breach_us"], r["warnings"], r["kill_us"]) for r in telemetry.stall_report(events, runs, ["run"], "t").collect()}
    assert got == {
        1: (None, None, 1, None),
        2: ("connect", 300 * S, 1, 300 * S),
        3: ("no_progress", 1810 * S, 2, 310 * S),
        4: ("connect", 300 * S, 1, 300 * S),
        5: (None, None, 1, None),
    }


def test_memory_limits(spark):
    runs = {
        1: [(10.0, 9e3), (85.0, 9e3), (96.0, 10.0), (99.0, 10.0)],
        2: [(10.0, 100.0), (None, 9e3), (None, 9e3), (99.0, 9e3)],
        3: [(None, 9e3), (5.0, 9e3), (None, 9e3), (7.0, 9e3)],
    }
    df = spark.createDataFrame(
        [(k, i, u, a) for k, r in runs.items() for i, (u, a) in enumerate(r)], "run int, t int, u double, av double"
    )
    got = {r["run"]: tuple(r)[1:] for r in telemetry.telemetry_limits(df, ["run"], ["t"], "u", "av", 100.0).collect()}
    assert got == {1: (96.0, 1, 2, False), 2: (10.0, None, None, True), 3: (7.0, None, None, False)}


def test_tree_total(spark):
    edges = spark.createDataFrame(
        [("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("f", "e"), ("g", "a")], "pid string, ppid string"
    )
    samples = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None), ("f", 8.0), ("g", 16.0)], "pid string, rss double")
    got = {r["pid"]: r["total"] for r in telemetry.tree_total(samples, edges, "pid", "ppid", "rss").collect()}
    assert got == {"a": 27.0, "b": 10.0, "c": None, "d": None, "e": None, "f": 8.0, "g": 16.0}


def plain_totals(parent, metric):
    total = {}
    for n, x in metric.items():
        seen = n
        while seen is not None:
            total[seen] = total.get(seen, 0) + x
            seen = parent.get(seen)
    return {n: t if n in metric else None for n, t in total.items()}


@pytest.mark.parametrize("kind", ["bushy", "chain", "mixed"])
def test_tree_total_by_rounds(spark, kind):
    """Contracted to a handful of nodes: bushy trees, chains, chains with leaves, sums per group."""
    rng = random.Random(kind)
    above = {"bushy": lambda i: rng.randrange(i), "chain": lambda i: i - 1, "mixed": lambda i: i - 1 if i % 3 else rng.randrange(i)}[kind]
    parent = {i: above(i) if i % 150 else None for i in range(300)}
    rows = [(i, g, rng.randrange(100)) for i in range(300) for g in ("a", "b", None) if rng.random() < 0.6]
    edges = spark.createDataFrame(list(parent.items()), "pid long, up long")
    samples = spark.createDataFrame(rows, "pid long, g string, m long")
    got = telemetry.tree_total(samples, edges, "pid", "up", "m", ["g"], finished_at_once=12).collect()
    for g in ("a", "b", None):
        assert {r.pid: r.total for r in got if r.g == g} == plain_totals(parent, {i: m for i, h, m in rows if h == g})


def test_tree_total_of_a_long_chain(spark):
    """100,000 nodes in a row: rounds of as many rows as are left, no pairs."""
    n = 100_000
    edges = spark.range(n).select(F.col("id").alias("pid"), F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    got = telemetry.tree_total(spark.range(n).select(F.col("id").alias("pid"), F.lit(1).alias("m")), edges, "pid", "up", "m", finished_at_once=40_000)
    assert got.filter(F.col("total") != n - F.col("pid")).count() == 0 and got.count() == n


@pytest.mark.parametrize("at_once", [0, 100])
def test_tree_total_refuses_circles_and_two_parents(spark, at_once):
    samples = spark.createDataFrame([(1, 1.0)], "node int, m double")
    edges = [(1, 2), (2, 3), (3, 1), (4, None), (5, 1), (6, 6)]
    with pytest.raises(ValueError, match="circle"):
        telemetry.tree_total(samples, spark.createDataFrame(edges, "node int, parent int"), "node", "parent", "m", finished_at_once=at_once)
    with pytest.raises(ValueError, match="several"):
        telemetry.tree_total(samples, spark.createDataFrame([(1, 2), (1, 3)], "node int, parent int"), "node", "parent", "m")


def test_unknown_rule_kind(spark):
    df = spark.createDataFrame([("x",)], "proxy string")
    with pytest.raises(ValueError, match="unknown kind"):
        q.validate_rows(df, {"proxy": {"kind": "proxy"}})


def test_parents_in_a_circle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "node int, parent int")
    with pytest.raises(ValueError, match="circle"):
        telemetry.ancestors(edges, "node", "parent")
