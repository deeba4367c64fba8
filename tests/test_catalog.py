import datetime as dt

import pytest
from pyspark.sql import functions as F

from lullmap.operators import catalog as cat

SCHEMA = "listing string, pos int, video_id string, url string, title string, duration double, view_count bigint, ts bigint"


def listing(spark, rows):
    full = [
        ("l", i, r.get("id", f"v{i}"), f"u{i}", r.get("title"), r.get("duration"), r.get("views"), r.get("ts"))
        for i, r in enumerate(rows, 1)
    ]
    return spark.createDataFrame(full, SCHEMA)


def titles(df):
    return {r["title"] for r in df.collect()}


@pytest.mark.parametrize(
    "spec, want",
    [
        ("!*archive*,!*undertale*", {"Speedrun glitchless", None}),
        ("*undertale*", {"UNDERTALE run", "Undertale archive"}),
        ("+*under*, !*archive*", {"UNDERTALE run"}),
        ("*", {"UNDERTALE run", "Undertale archive", "Speedrun glitchless", "old archive"}),
        ("[us]* *[rg]*", {"UNDERTALE run", "Undertale archive", "Speedrun glitchless"}),
        ("[!u]*", {"Speedrun glitchless", "old archive"}),
        ("old?archive", {"old archive"}),
        ("a.b", set()),
    ],
)
def test_glob_filter(spark, spec, want):
    names = ["UNDERTALE run", "Undertale archive", "Speedrun glitchless", "old archive", None]
    df = listing(spark, [{"title": t} for t in names])
    assert titles(cat.glob_filter(df, "title", spec)) == want


@pytest.mark.parametrize("spec", ["", " , ", "!", "a,+ "])
def test_glob_spec_errors(spec):
    with pytest.raises(ValueError):
        cat.glob_terms(spec)


def test_meta_filter_keeps_unknown(spark):
    df = listing(spark, [{"title": "a", "duration": 5.0}, {"title": "b"}, {"title": "c", "duration": 60.0, "ts": 10}])
    assert titles(cat.meta_filter(df, 30.0)) == {"b", "c"}
    assert titles(cat.meta_filter(df, 0.0, 11)) == {"a", "b"}


def test_parse_since():
    now = dt.datetime(2026, 8, 20, tzinfo=dt.timezone.utc)
    assert cat.parse_since("-3d", now) == now - dt.timedelta(days=3)
    assert cat.parse_since("-1.5W", now) == now - dt.timedelta(days=10.5)
    assert cat.parse_since("-2m", now) == now - dt.timedelta(days=60)
    assert cat.parse_since("2026-08-01", now) == dt.datetime(2026, 8, 1, tzinfo=dt.timezone.utc)
    for bad in ("", "2026-8-1", "3d", "-3y"):
        with pytest.raises(ValueError):
            cat.parse_since(bad, now)


@pytest.mark.parametrize("spec, want", [("5,1-2", [1, 2, 5]), ("4-2", [2, 3, 4]), ("1,1,1", [1])])
def test_select_positions(spark, spec, want):
    df = listing(spark, [{}] * 5).drop("pos").withColumn("n", F.substring("url", 2, 9).cast("int"))
    assert sorted(r["n"] for r in cat.select_positions(df, spec, ["n"]).collect()) == want
    assert sorted(r["n"] for r in cat.select_positions(df, spec, ["n"], ["listing"]).collect()) == want


def test_select_positions_errors(spark):
    df = listing(spark, [{}] * 5).drop("pos")
    with pytest.raises(Exception, match="outside the table"):
        cat.select_positions(df, "6", ["url"]).collect()
    with pytest.raises(Exception, match="outside the table"):
        cat.select_positions(df, "1,7-9", ["url"]).collect()
    for bad in ("", "x", "1-", "0"):
        with pytest.raises(ValueError):
            cat.parse_picks(bad)


def ranked(df, key):
    return [r["pos"] for r in sorted(cat.sort_catalog(df, key).collect(), key=lambda r: r["rank"])]


def test_sort_catalog(spark):
    lengths = listing(spark, [{"duration": None}, {"duration": 300.0}, {"duration": 100.0}])
    assert ranked(lengths, "duration") == [2, 3, 1]
    views = listing(spark, [{"views": 5}, {"views": None}, {"views": 5}, {"views": 9}])
    assert ranked(views, "views") == [4, 1, 3, 2]
    dated = listing(spark, [{"ts": 5}, {"ts": None}, {"ts": 7}])
    assert ranked(dated, "date") == [3, 1, 2]
    numbered = listing(spark, [{"id": "v10"}, {"id": "abc1"}, {"id": "v9"}, {"id": "200"}, {"id": "v1x"}])
    assert ranked(numbered, "date") == [2, 5, 4, 1, 3]
    with pytest.raises(ValueError):
        cat.sort_catalog(dated, "title")


def test_resume(spark):
    entries = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3"), ("d", None)], "title string, url string")
    done = spark.createDataFrame([("u1",)], "url string")
    assert titles(cat.unfinished(entries, done)) == {"b", "c"}
    more = spark.createDataFrame([("u0",), ("u1",)], "url string")
    assert sorted(r["url"] for r in cat.merge_completed(done, more).collect()) == ["u0", "u1"]


def test_recent_top_k(spark):
    used = [("x", i, t) for t, i in enumerate("abcde")]
    rows = lambda log: [
        r["item"]
        for r in sorted(
            cat.recent_top_k(spark.createDataFrame(log, "user string, item string, ts int"), "user", "item", "ts", 3).collect(),
            key=lambda r: r["rank"],
        )
    ]
    assert rows(used) == ["e", "d", "c"]
    assert rows(used + [("x", "b", 9)]) == ["b", "e", "d"]


def test_latest_checkpoint(spark):
    df = spark.createDataFrame(
        [("a", "main", 0, 5, True), ("a", "inuse", 0, 7, True), ("a", "old", 1, 9, True), ("b", "old", 2, 1, True), ("b", "older", 1, 1, False)],
        "k string, name string, priority int, mtime bigint, there boolean",
    )
    got = {r["k"]: r["name"] for r in cat.latest_checkpoint(df, ["k"], "mtime", "priority", F.col("there")).collect()}
    assert got == {"a": "inuse", "b": "old"}


def test_latest_checkpoint_ties(spark):
    rows = [("k", "b", 5, 0), ("k", "a", 5, 0), ("l", "y", 3, 2), ("l", "x", 3, 2)]
    df = spark.createDataFrame(rows, "k string, name string, mtime long, priority int").repartition(4)
    got = {r["k"]: r["name"] for r in cat.latest_checkpoint(df, ["k"], "mtime", "priority").collect()}
    assert got == {"k": "a", "l": "x"}


def test_queue_problems(spark):
    """A listing that the filters empty and one that is too short are told, and stop nothing."""
    queue = spark.createDataFrame([(1, "full"), (2, "emptied"), (3, "short"), (4, "https://x.org/v")], "line_no int, entry string")
    rows = [(l, i, f"{l}{i}", f"u{l}{i}", t, 60.0, 1, None) for l, n, t in (("full", 4, "good"), ("emptied", 3, "bad"), ("short", 1, "good")) for i in range(n)]
    catalog = spark.createDataFrame(rows, "listing string, pos int, video_id string, url string, title string, duration double, view_count long, ts long")
    got = cat.expand_queue(queue, catalog, "1,3", "views", "good").collect()
    assert sorted((r["line_no"], r["rank"]) for r in got) == [(1, 1), (1, 3), (4, 1)]
    told = cat.queue_problems(queue, catalog, "1,3", "good").collect()
    assert sorted(tuple(r) for r in told) == [(2, "emptied", 0, "empty"), (3, "short", 1, "short")]
