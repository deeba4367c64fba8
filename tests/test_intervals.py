import random

import pytest
import spec
from pyspark.sql import functions as F

from lullmap.operators import intervals as iv
from lullmap.operators import quiet
from lullmap.plans.blocks import RangeBlocks, TimeBlocks, WholeSeries, pick_blocks

K = ["series_id"]
IV = "series_id bigint, start_us bigint, end_us bigint"
ENDS = "series_id bigint, end_us bigint"
CUTS = [WholeSeries(), TimeBlocks(40), RangeBlocks(5)]
S = 1_000_000


def table(spark, by_series):
    rows = [(k, s, e) for k, spans in by_series.items() for s, e in spans]
    return spark.createDataFrame(rows, IV)


def seconds(spark, spans):
    return table(spark, {1: [(round(s * S), round(e * S)) for s, e in spans]})


def gathered(df, keys=None):
    out = {}
    for row in df.collect():
        out.setdefault(row["series_id"], []).append((row["start_us"], row["end_us"]))
    return {k: sorted(v) for k, v in out.items()}


def in_seconds(df):
    return [(s / S, e / S) for s, e in gathered(df).get(1, [])]


@pytest.fixture(scope="module")
def wild():
    rng = random.Random(7)
    return {
        k: sorted((a, a + rng.randint(0, 30)) for a in (rng.randint(-10, 200) for _ in range(rng.randint(1, 25))))
        for k in range(300)
    }


@pytest.mark.parametrize("blocks", CUTS, ids=str)
def test_merge_against_spec(spark, wild, blocks):
    df = table(spark, wild)
    want = {k: spec.merge(v) for k, v in wild.items()}
    assert gathered(iv.merge_intervals(df, K, blocks=blocks)) == want
    want = {k: spec.merge(v, lambda g: g <= 0) for k, v in wild.items()}
    assert gathered(iv.merge_intervals(df, K, touch=True, blocks=blocks)) == want
    want = {k: spec.merge(v, lambda g: g < 7) for k, v in wild.items()}
    assert gathered(iv.merge_intervals(df, K, min_gap_us=7, blocks=blocks)) == want


@pytest.mark.parametrize("blocks", CUTS, ids=str)
@pytest.mark.parametrize("m", [-9, -2, 0, 3])
def test_margin_against_spec(spark, wild, blocks, m):
    ends = spark.createDataFrame([(k, 150) for k in wild if k % 2], ENDS)
    want = {k: spec.margin(v, m, 150 if k % 2 else None) for k, v in wild.items()}
    got = gathered(iv.apply_margin(table(spark, wild), K, m, ends, blocks))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("blocks", CUTS, ids=str)
def test_keep_against_spec(spark, wild, blocks):
    ends = {**{k: 100 + k for k in wild}, 900: 50, 901: 0, 902: None}
    df = spark.createDataFrame(list(ends.items()), ENDS)
    want = {k: spec.keep(wild.get(k, []), e, 5) for k, e in ends.items() if e}
    got = gathered(iv.keep_intervals(table(spark, wild), df, K, 5, blocks))
    assert got == {k: v for k, v in want.items() if v}
    assert {r["series_id"]: r["reason"] for r in iv.invalid_ends(df, K).collect()} == {
        901: "end is not positive",
        902: "unknown end",
    }


@pytest.mark.parametrize("blocks", CUTS, ids=str)
@pytest.mark.parametrize("closed", [True, False])
def test_quiet_against_spec(spark, blocks, closed):
    rng = random.Random(3)
    rows = {
        k: [(t, rng.choice([0.1, -0.2, 5.0])) for t in sorted(rng.sample(range(300), rng.randint(1, 60)))]
        for k in range(120)
    }
    df = spark.createDataFrame(
        [(k, t, v) for k, r in rows.items() for t, v in r], "series_id bigint, t bigint, v double"
    )
    ends = spark.createDataFrame([(k, 310) for k in rows], ENDS) if closed else None
    got = gathered(quiet.detect_quiet(df, K, "t", "v", 1.0, 6, ends, blocks=blocks))
    want = {k: spec.quiet(r, 1.0, 6, 310 if closed else None) for k, r in rows.items()}
    assert got == {k: v for k, v in want.items() if v}

    gaps = gathered(quiet.detect_gaps(df, K, "t", 8, blocks))
    pairs = {k: [(a, b) for (a, _), (b, _) in zip(r, r[1:]) if b - a > 8] for k, r in rows.items()}
    assert gaps == {k: v for k, v in pairs.items() if v}

    bursts = {}
    for r in quiet.activity_sessions(df, K, "t", 8, blocks).collect():
        bursts.setdefault(r["series_id"], []).append((r["start_us"], r["end_us"], r["rows"]))
    for k, r in rows.items():
        runs = [[r[0][0]]]
        for (a, _), (b, _) in zip(r, r[1:]):
            runs[-1].append(b) if b - a <= 8 else runs.append([b])
        assert sorted(bursts[k]) == [(x[0], x[-1], len(x)) for x in runs]


def test_equal_keys_at_one_instant_still_split(spark):
    df = spark.createDataFrame([(1, 5, i, 0.0 if i % 3 else 9.0) for i in range(200)], "series_id bigint, t bigint, i bigint, v double")
    ends = spark.createDataFrame([(1, 50)], ENDS)
    runs = lambda b: gathered(quiet.quiet_runs(df, K, "t", F.col("v") < 1, ["t", "i"], ends, b))
    assert runs(RangeBlocks(6)) == runs(WholeSeries()) == {1: [(5, 50)]}


@pytest.mark.parametrize(
    "spans, m, end, want",
    [
        ([(2, 4)], 0.5, None, [(2.5, 3.5)]),
        ([(2, 4)], -0.5, None, [(1.5, 4.5)]),
        ([(0.3, 1.0)], 0.5, None, []),
        ([(1, 2.5), (2, 3.5)], -0.3, None, [(0.7, 3.8)]),
        ([(50, 60), (66, 80)], -10, None, [(40, 63), (63, 90)]),
        ([(1, 2), (2, 3.5)], -0.3, None, [(0.7, 3.8)]),
        ([(50, 60)], -3, 120, [(47, 63)]),
    ],
)
def test_margin_cases(spark, spans, m, end, want):
    ends = spark.createDataFrame([(1, end * S)], ENDS) if end else None
    assert in_seconds(iv.apply_margin(seconds(spark, spans), K, round(m * S), ends)) == want


@pytest.mark.parametrize(
    "spans, want",
    [
        ([(1, 2), (4, 5)], [(0, 1), (2, 4), (5, 10)]),
        ([], [(0, 10)]),
        ([(0, 10)], []),
        ([(1, 2), (2.1, 3)], [(0, 1), (2, 2.1), (3, 10)]),
        ([(-1, 2)], [(2, 10)]),
        ([(8, 15)], [(0, 8)]),
        ([(5, 5), (6, 4), (2, 3)], [(0, 2), (3, 10)]),
        ([(1, 4), (2, 5)], [(0, 1), (5, 10)]),
    ],
)
def test_keep_cases(spark, spans, want):
    ends = spark.createDataFrame([(1, 10 * S)], ENDS)
    assert in_seconds(iv.keep_intervals(seconds(spark, spans), ends, K)) == want


def test_split_long(spark):
    lengths = lambda spans: [e - s for s, e in in_seconds(iv.split_long(seconds(spark, spans)))]
    assert lengths([(0, 300)]) == [300]
    assert len(lengths([(0, 12536)])) == 42
    assert lengths([(10, 700)]) == [300, 300, 90]


@pytest.mark.parametrize("blocks", CUTS, ids=str)
def test_chunks(spark, blocks):
    spans = {k: [(10 * i, 10 * i + 4) for i in range(n)] for k, n in {1: 7, 2: 150, 3: 450}.items()}
    got = {}
    for r in iv.chunk_intervals(table(spark, spans), K, 20, blocks).collect():
        got.setdefault(r["series_id"], {})[r["chunk"]] = (r["start_us"], r["end_us"], r["intervals"], r["total_us"])
    assert got[1] == {0: (0, 64, 7, 28)}
    assert len(got[2]) == 8 and got[2][7][2] == 10
    assert len(got[3]) == 57 and got[3][0][2] == 8


def test_buckets(spark):
    at = lambda spans, **kw: [
        (r["x_left"], r["x_right"])
        for r in iv.project_to_buckets(seconds(spark, spans), 0, 100 * S, 800, **kw).collect()
    ]
    assert at([(10, 20)]) == [(80, 160)]
    assert at([(90, 200)]) == [(720, 800)]
    assert at([(10, 10.01)]) == [(80, 81)]
    assert at([(2.5, 7.5)], n_peaks=20) == [(0, 80)]
    assert at([(120, 130)]) == []


def test_view_buckets(spark):
    peaks = spark.createDataFrame([(1, i, 0.1 * i) for i in range(10)], "series_id bigint, bucket int, peak double")
    spread = spark.createDataFrame([(1, 10 * S, 10)], "series_id bigint, end_us bigint, n_peaks int")
    shown = lambda a, b: sorted(
        r["bucket"] for r in iv.view_buckets(peaks, round(a * S), round(b * S), spread, K).collect()
    )
    assert shown(2.5, 7.5) == [2, 3, 4, 5, 6, 7]
    assert shown(5, 3) == []
    assert shown(-3, 0.5) == [0]


def test_below_threshold_runs(spark):
    loud = [0.001] * 5 + [0.5] * 5 + [0.001] * 5 + [0.5] * 5
    peaks = spark.createDataFrame([(1, i, p) for i, p in enumerate(loud)], "series_id bigint, bucket int, peak double")
    runs = lambda width: sorted(
        (r["x_left"], r["x_right"])
        for r in quiet.below_threshold_runs(peaks, K, quiet.amplitude(-30), width).collect()
    )
    assert runs(4) == [(0, 1), (2, 3)]
    assert runs(20) == [(0, 5), (10, 15)]
    assert runs(40) == [(0, 10), (20, 30)]


def test_ranges_are_checked(spark):
    with pytest.raises(ValueError):
        quiet.detect_quiet_db(None, K, "t", "v", threshold_db=-90)


def test_pick_blocks_measures(spark):
    df = spark.createDataFrame([(1, i * S) for i in range(200)], "series_id bigint, t bigint")
    df = df.repartition(2)
    import lullmap.plans.blocks as b

    assert isinstance(pick_blocks(df, K, "t", 1000), WholeSeries)
    assert pick_blocks(df, K, "t", 100) == TimeBlocks(b.MINUTE)
    same = df.withColumn("t", F.lit(0).cast("long"))
    assert isinstance(pick_blocks(same, K, "t", 100), RangeBlocks)
