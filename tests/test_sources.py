import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lullmap.sources import files, lines, stores


def put(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)
    return path


def test_read_listing(spark, scratch):
    put(scratch, "a.txt", "v1::12.5::7.0::1700000000::A :: title\nbad line\n::1::2::3::x\nv2::NA::NA::nan::\n")
    rows = lines.read_listing(spark, scratch, "twitch").orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [
        (1, "v1", "https://www.twitch.tv/videos/1", "A :: title", 12.5, 7, 1700000000),
        (4, "v2", "https://www.twitch.tv/videos/2", None, None, None, None),
    ]


def test_read_queue_numbers_lines(spark, scratch):
    put(scratch, "q.txt", "# comment\r\nhttps://a\r\n\r\n  https://b  \n")
    got = [(r["line_no"], r["entry"]) for r in lines.read_queue(spark, scratch).orderBy("line_no").collect()]
    assert got == [(2, "https://a"), (4, "https://b")]


def test_line_order_across_splits(spark, scratch):
    put(scratch, "long.txt", "".join(f"line {i}\n" for i in range(1, 20001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = lines.numbered_lines(spark, scratch)
        assert got.rdd.getNumPartitions() >= 1
        wrong = got.filter(F.concat(F.lit("line "), F.col("line_no").cast("string")) != F.col("line"))
        assert got.count() == 20000 and wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "line, want",
    [
        ("progress|500|NA|1000|100|5", (500.0, 1000.0, 100.0, 5.0)),
        ("progress|500|900|1500|100|5", (500.0, 900.0, 100.0, 5.0)),
        ("progress|NaN|NA|NA|NA|NA", (None, None, None, None)),
        ("progress|inf||x|-1|1e3", (None, None, -1.0, 1000.0)),
        ("progress|1|2|3|4", None),
        ("/path/file.mp4", None),
    ],
)
def test_progress(spark, line, want):
    rows = lines.parse_progress(spark.createDataFrame([(line,)], "value string")).collect()
    assert ([tuple(r) for r in rows] or [None]) == [want]


def test_read_progress_keeps_order(spark, scratch):
    put(scratch, "p.log", "x\nprogress|1|2|3|4|5\nprogress|2|2|3|4|5\n")
    rows = lines.read_progress(spark, scratch).orderBy(*lines.LINE_ORDER).collect()
    assert [r["downloaded_bytes"] for r in rows] == [1.0, 2.0]


def test_quiet_log(spark, scratch):
    put(
        scratch,
        "d.log",
        "silence_end: 1\n[x] silence_start: -0.02\nframe\nsilence_start: 1,5\n"
        "silence_end: 2,75 | silence_duration: 1\nsilence_start: 3 silence_end: 9\nsilence_end: 4\nsilence_start: 8\n",
    )
    source = lines.read_queue(spark, scratch).select("source").first()[0]
    ends = spark.createDataFrame([(source, 10_000_000)], "source string, end_us bigint")
    at = lambda e: sorted((r["start_us"], r["end_us"]) for r in lines.read_quiet_log(spark, scratch, e).collect())
    assert at(None) == [(1_500_000, 2_750_000), (3_000_000, 4_000_000)]
    assert at(ends) == at(None) + [(8_000_000, 10_000_000)]


def test_tagged_lines_of_many_sources(spark, scratch):
    """Files follow the size, not the sources; tags may hold anything, and other lines may hold tabs."""
    names = [f"user {i}" for i in range(200)] + ["a\tb", "é/=%2B+", ""]
    rows = [(n, i, f"progress|{i}|NA|{len(n)}|1|\t2" if i % 2 else f"x\ty{i}") for n in names for i in range(9, -1, -1)]
    path = os.path.join(scratch, "tagged")
    lines.write_tagged_lines(spark.createDataFrame(rows, "name string, i int, line string"), "name", ["i"], "line", path)
    assert sum(f.startswith("part") for f in os.listdir(path)) <= 8
    put(path, "other.txt", "progress|1|2|3|4|5\n")
    got = {}
    for r in lines.file_lines(spark, path, tagged=True).orderBy(*lines.LINE_ORDER).collect():
        got.setdefault(r["source"], []).append(r["line"])
    assert got == {n: [line for m, _, line in reversed(rows) if m == n] for n in names}
    found = lines.read_progress(spark, path, tagged=True).orderBy(*lines.LINE_ORDER).collect()
    assert [r["downloaded_bytes"] for r in found if r["source"] == "a\tb"] == [1.0, 3.0, 5.0, 7.0, 9.0]


def test_tagged_quiet_log(spark, scratch):
    marks = ["silence_end: 1", "silence_start: 2", "frame", "silence_end: 3,5", "silence_start: 4"]
    rows = [(f"s{k}", i, m) for k in range(50) for i, m in enumerate(marks)]
    path = os.path.join(scratch, "tagged")
    lines.write_tagged_lines(spark.createDataFrame(rows, "name string, i int, line string"), "name", ["i"], "line", path)
    got = sorted(map(tuple, lines.read_quiet_log(spark, path, tagged=True).collect()))
    assert got == sorted((f"s{k}", 2_000_000, 3_500_000) for k in range(50))


@pytest.mark.parametrize("name", ["read_progress", "read_quiet_log"])
def test_logs_of_many_users_take_few_files(spark, sf, monkeypatch, name):
    from lullmap.bindings import QUERIES, sourcing

    made = []
    monkeypatch.setattr(sourcing, "new_folder", lambda *a, own=sourcing.new_folder: made.append(own(*a)) or made[-1])
    QUERIES[name](spark, sf)
    assert sum(f.startswith("part") for _, _, names in os.walk(made[0]) for f in names) <= 8


def test_json_logs(spark, scratch):
    put(scratch, "l.json", '{"ts": "t", "level": "INFO", "msg": "m", "v": 1, "bytes": 5}\nnot json\n')
    rows = lines.read_json_logs(spark, scratch).orderBy("level").collect()
    assert rows[0]["_corrupt_record"] == "not json" and rows[1]["bytes"] == 5 and rows[1]["phase"] is None
    out = os.path.join(scratch, "out")
    lines.write_json_logs(lines.read_json_logs(spark, scratch).filter("level is not null"), out)
    written = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.startswith("part"))
    assert json.loads(written) == {"ts": "t", "level": "INFO", "msg": "m", "v": 1, "bytes": 5}


def wav(samples, extra=b""):
    body = np.asarray(samples, dtype="<i2").tobytes()
    chunks = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + extra
    chunks += b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def test_read_pcm(spark, scratch):
    rng = np.random.default_rng(1)
    signal = rng.integers(-32768, 32768, 256 * 21 + 100)
    signal[300] = -32768
    put(scratch, "a.wav", wav(signal, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    put(scratch, "b.raw", np.asarray(signal, dtype="<i2").tobytes() + b"\x01")
    put(scratch, "c.raw", b"\x01")
    want = [np.abs(signal[i : i + 256].astype(int)).max() / 32768 for i in range(0, len(signal), 256)]
    for ranges in (4, 65_536):
        got = {}
        for r in files.read_pcm(spark, scratch, ranges).collect():
            got.setdefault(os.path.basename(r["source"]), {})[r["bucket"]] = r["peak"]
        assert set(got) == {"a.wav", "b.raw"}
        for peaks in got.values():
            assert [peaks[i] for i in range(22)] == want


def test_interval_cache(spark, scratch):
    path = os.path.join(scratch, "cache")
    config = {"threshold": -30, "min_silence": 2, "margin": 0.5}
    rows = lambda source, start: spark.createDataFrame(
        [(source, 10, start, start + 5)], "source string, source_size bigint, start_us bigint, end_us bigint"
    )
    stores.write_interval_cache(rows("a", 1), path, config)
    stores.write_interval_cache(rows("a", 100), path, {**config, "margin": 1})
    stores.write_interval_cache(rows("a", 2).unionByName(rows("b", 3)), path, {**config, "threshold": -30.0})
    ask = lambda source, size, at: spark.createDataFrame(
        [(source, size)], "source string, source_size bigint"
    ).withColumn("source_mtime", F.lit(at).cast("timestamp"))
    starts = lambda request, c=config: [r["start_us"] for r in stores.read_interval_cache(spark, path, request, c).collect()]
    assert starts(ask("a", 10, "2020-01-01")) == [2]
    assert starts(ask("a", 11, "2020-01-01")) == []
    assert starts(ask("a", 10, "2100-01-01")) == []
    assert starts(ask("a", 10, "2020-01-01"), {**config, "margin": 1.0}) == [100]


def test_batch_state(spark, scratch):
    document = {"version": 1, "entries": [{"title": "a", "url": "u1"}, {"title": None, "url": "u2"}], "completed_urls": ["u1"], "dry_run": False}
    put(scratch, "batch.json", json.dumps(document, indent=2))
    entries, done = stores.read_batch_document(spark, os.path.join(scratch, "batch.json"))
    assert [(r["pos"], r["title"], r["url"]) for r in entries.orderBy("pos").collect()] == [(0, "a", "u1"), (1, None, "u2")]
    out = os.path.join(scratch, "state")
    stores.write_batch_state(entries, done, out)
    again, completed = stores.read_batch_state(spark, out)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, entries.collect()), key=repr)
    assert [r["url"] for r in completed.collect()] == ["u1"]


def test_interval_cache_keeps_every_source(spark, scratch):
    path, config = f"{scratch}/cache", {"threshold": -30, "min_silence": 2.0, "margin": 0.5}
    put = lambda rows, heads: stores.write_interval_cache(
        spark.createDataFrame(rows, "source string, source_size long, start_us long, end_us long"),
        path,
        config,
        spark.createDataFrame(heads, "source string, source_size long, probe_us long"),
    )
    put([("a", 10, 0, 5), ("a", 10, 7, 9)], [("a", 10, 20), ("empty", 3, 8)])
    put([("b", 5, 1, 2)], [("b", 5, None)])
    put([("b", 6, 3, 4)], [("b", 6, 9)])
    asked = spark.createDataFrame([("a", 10), ("empty", 3), ("b", 5), ("c", 1)], "source string, source_size long")
    asked = asked.withColumn("source_mtime", F.lit("2020-01-01").cast("timestamp"))
    heads = {r["source"]: r["probe_us"] for r in stores.cached_sources(spark, path, asked, config).collect()}
    assert heads == {"a": 20, "empty": 8}
    got = stores.read_interval_cache(spark, path, asked, config).collect()
    assert sorted((r["source"], r["start_us"], r["end_us"]) for r in got) == [("a", 0, 5), ("a", 7, 9)]
    grown = asked.withColumn("source_size", F.when(F.col("source") == "b", 6).otherwise(F.col("source_size")))
    got = stores.read_interval_cache(spark, path, grown, config).filter("source = 'b'").collect()
    assert [(r["start_us"], r["end_us"]) for r in got] == [(3, 4)]


def test_batch_state_merges(spark, scratch):
    path = f"{scratch}/state"
    entries = lambda rows: spark.createDataFrame(rows, "batch string, pos int, title string, url string")
    done = lambda rows: spark.createDataFrame(rows, "batch string, url string")
    stores.write_batch_state(entries([("x", 1, "t", "u1"), ("y", 1, "t", "u9")]), done([("x", "u1")]), path, merge=True)
    stores.write_batch_state(entries([("x", 1, "t", "u1"), ("x", 2, "t", "u2")]), done([("x", "u2")]), path, merge=True)
    kept, completed = stores.read_batch_state(spark, path)
    assert sorted((r["batch"], r["url"]) for r in kept.collect()) == [("x", "u1"), ("x", "u2"), ("y", "u9")]
    assert sorted(tuple(r) for r in completed.collect()) == [("x", "u1"), ("x", "u2")]
