import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lullmap.streaming.detect import stream_quiet, stream_sessions
from lullmap.streaming.monitor import stream_progress, stream_stalls

S = 1_000_000
ROWS = "k bigint, at bigint, v double, fin bigint"


def feed(folder, n, rows):
    """One file per micro-batch."""
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    data = {name: pa.array(c, t) for name, c, t in zip(("k", "at", "v", "fin"), cols, types)}
    pq.write_table(pa.table(data), os.path.join(folder, f"{n:03}.parquet"))
    past = time.time() - 1000 + n
    os.utime(os.path.join(folder, f"{n:03}.parquet"), (past, past))


def stream(spark, folder):
    raw = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
    return raw.withColumn("ts", F.timestamp_micros("at"))


def emitted(spark, result, name, state):
    q = (
        result.writeStream.format("memory").queryName(name).option("checkpointLocation", state).outputMode("append").start()
    )
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted((tuple(r) for r in spark.table(name).collect()), key=lambda r: [(x is not None, x) for x in r])


def test_quiet_closes_across_batches(spark, scratch):
    src, state = os.path.join(scratch, "in"), os.path.join(scratch, "state")
    os.mkdir(src)
    hour = 3600 * S
    feed(src, 1, [(1, 0, 5.0, None), (1, 10 * S, 0.1, None), (2, 5 * S, 0.1, 30 * S), (3, 5 * S, 0.1, None)])
    feed(src, 2, [(1, 20 * S, 0.2, None), (1, 40 * S, 9.0, None), (1, 41 * S, 0.0, None), (1, 41 * S + 1, 9.0, None)])
    feed(src, 3, [(1, 15 * S, 9.0, None), (1, 50 * S, 0.0, None), (1, 70 * S, 8.0, None)])
    feed(src, 4, [(9, 9 * hour, 5.0, None)])
    feed(src, 5, [(9, 9 * hour + S, 5.0, None)])
    quiet = stream_quiet(stream(spark, src), ["k"], "ts", "v", 1.0, 5 * S, "fin", "1 minute")
    assert emitted(spark, quiet, "quiet_out", state) == [
        (1, 10 * S, 40 * S),
        (1, 50 * S, 70 * S),
        (2, 5 * S, 30 * S),  # closed at its known end, by the watermark
    ]


def test_quiet_resumes_from_a_table(spark, scratch):
    src = os.path.join(scratch, "in")
    os.mkdir(src)
    feed(src, 1, [(1, 90 * S, 5.0, None), (1, 80 * S, 0.1, None), (2, 90 * S, 5.0, None)])
    start = spark.createDataFrame(
        [(1, 50 * S, 60 * S, None)], "k bigint, start_us bigint, last_us bigint, end_us bigint"
    )
    quiet = stream_quiet(stream(spark, src), ["k"], "ts", "v", 1.0, S, initial_state=start)
    assert emitted(spark, quiet, "resumed_out", os.path.join(scratch, "s")) == [(1, 50 * S, 90 * S)]


class Handle:
    """State and timers of one series, and how often the timers were listed."""

    def __init__(self):
        self.value, self.timers, self.listed = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        self.listed += 1
        return set(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("known_end", [False, True])
def test_quiet_takes_rows_and_asks_for_timers_only_where_there_may_be_some(known_end):
    import random

    from pyspark.sql import Row

    from lullmap.streaming.detect import _QuietProcessor

    rng = random.Random(7)
    handle, processor = Handle(), _QuietProcessor(["k"], 3, True, None)
    processor.init(handle)
    got, want, late, start, last, end = [], [], 0, None, None, None
    for batch in range(30):
        times = rng.sample(range(batch * 20 - 8, batch * 20 + 20), rng.randrange(1, 15))
        rows = [Row(row_us=t, row_quiet=rng.random() < 0.6, row_end_us=10_000 + t if known_end and t % 3 == 0 else None) for t in times]
        got += processor.handleInputRows((1,), iter(rows), handle)
        first = last
        for r in sorted(rows, key=lambda r: r.row_us):
            if first is not None and r.row_us < first:
                late += 1
                continue
            last, end = r.row_us, end if r.row_end_us is None else r.row_end_us
            if r.row_quiet:
                start = r.row_us if start is None else start
            elif start is not None:
                want += [(start, r.row_us)] if r.row_us - start >= 3 else []
                start = None
        assert handle.value == (start, last, end)
        assert handle.timers == ({max(end // 1000, 1)} if start is not None and end is not None else set())
    assert [(r.start_us, r.end_us) for r in got if r.start_us is not None] == want
    assert sum(r.late_rows for r in got) == late > 0
    assert (handle.listed > 0) == known_end


def test_sessions(spark, scratch):
    src = os.path.join(scratch, "in")
    os.mkdir(src)
    feed(src, 1, [(1, 0, 0.0, None), (1, 10 * S, 0.0, None), (1, 21 * S, 0.0, None)])
    feed(src, 2, [(1, 500 * S, 0.0, None)])
    feed(src, 3, [(1, 505 * S, 0.0, None)])
    feed(src, 4, [(1, 30 * S, 0.0, None), (1, 900 * S, 0.0, None)])
    result = stream_sessions(stream(spark, src), ["k"], "ts", "10 seconds", "1 minute")
    got = emitted(spark, result, "sessions_out", os.path.join(scratch, "s"))
    # A gap equal to the limit still joins; the late row at 30 s is dropped.
    assert got == [(1, 0, 10 * S, 2), (1, 21 * S, 21 * S, 1), (1, 500 * S, 505 * S, 2)]


def test_progress(spark, scratch):
    src = os.path.join(scratch, "in")
    os.mkdir(src)
    feed(src, 1, [(1, 0, 0.0, None), (1, 10 * S, 0.5, None)])
    feed(src, 2, [(1, 20 * S, 0.4, None), (1, 30 * S, 0.5, None)])
    rows = stream(spark, src).select("k", "ts", F.lit("cut").alias("phase"), F.col("v").alias("fraction"))
    got = emitted(spark, stream_progress(rows, ["k"], "ts"), "progress_out", os.path.join(scratch, "s"))
    assert got == [
        (1, 0, "cut", 0.0, 0.0, None),
        (1, 10 * S, "cut", 0.5, 10.0, 10.0),
        (1, 30 * S, "cut", 0.5, 30.0, 10.0 + 0.25 * 20.0),
    ]


def test_stalls(spark, scratch):
    src = os.path.join(scratch, "in")
    os.mkdir(src)
    feed(src, 1, [(1, 7 * S, 0.0, None)])
    result = stream_stalls(stream(spark, src), ["k"], "ts", 1.0, 4.0)
    q = (
        result.writeStream.format("memory").queryName("stalls_out").outputMode("append")
        .option("checkpointLocation", os.path.join(scratch, "s")).trigger(processingTime="500 milliseconds").start()
    )
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("stalls_out").count() < 2:
            time.sleep(0.5)
    finally:
        q.stop()
    got = [tuple(r) for r in spark.table("stalls_out").orderBy("silent_s").collect()]
    assert got == [(1, "warn", 7 * S, 1.0), (1, "kill", 7 * S, 4.0)]
    with pytest.raises(ValueError):
        stream_stalls(stream(spark, src), ["k"], "ts", 4.0, 4.0)


def test_hooks(spark, scratch):
    from lullmap.streaming.hooks import ProgressListener, on_intervals

    src = os.path.join(scratch, "in")
    os.mkdir(src)
    feed(src, 1, [(1, 5 * S, 0.0, None), (1, 10 * S, 5.0, None)])
    got, seen = [], []
    listener = ProgressListener(lambda name, batch, rows: seen.append((name, rows)))
    spark.streams.addListener(listener)
    quiet = stream_quiet(stream(spark, src), ["k"], "ts", "v", 1.0, S)
    q = (
        on_intervals(quiet, lambda batch, n: got.extend(tuple(r) for r in batch.collect()))
        .queryName("hooked").option("checkpointLocation", os.path.join(scratch, "s")).start()
    )
    try:
        q.processAllAvailable()
        until = time.time() + 20
        while ("hooked", 2) not in seen and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
        spark.streams.removeListener(listener)
    assert got == [(1, 5 * S, 10 * S)] and ("hooked", 2) in seen


def test_late_rows_are_counted_and_series_forgotten(spark, scratch):
    src, state = os.path.join(scratch, "in"), os.path.join(scratch, "state")
    os.mkdir(src)
    hour = 3600 * S
    feed(src, 1, [(1, 20 * S, 0.1, None), (1, 40 * S, 9.0, None)])
    feed(src, 2, [(1, 10 * S, 0.0, None), (1, 30 * S, 9.0, None), (1, 41 * S, 0.0, None)])
    feed(src, 3, [(9, 9 * hour, 5.0, None)])
    feed(src, 4, [(9, 9 * hour + S, 5.0, None)])
    feed(src, 5, [(1, 9 * hour + 2 * S, 5.0, None), (9, 9 * hour + 2 * S, 5.0, None)])
    quiet = stream_quiet(
        stream(spark, src), ["k"], "ts", "v", 1.0, 5 * S, watermark="1 minute", count_late=True, forget_after_us=hour
    )
    # The run open at 41 s is forgotten with its series, so the loud row hours later ends nothing.
    assert sorted(emitted(spark, quiet, "late_out", state), key=repr) == [(1, 20 * S, 40 * S, 0), (1, None, None, 2)]


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_resume_from_stored_probes(spark, scratch, stop):
    """Stopped after any batch, written to the cache, gone on from there by a new query: as in one go."""
    from lullmap.operators.quiet import detect_quiet
    from lullmap.sources.stores import compact_interval_cache, read_interval_cache
    from lullmap.streaming import resume

    batches = [
        [(1, 0, 5.0, None), (1, 10 * S, 0.1, None), (2, 3 * S, 9.0, None), (3, 1 * S, 0.1, None)],
        [(1, 20 * S, 0.1, None), (1, 30 * S, 9.0, None), (1, 31 * S, 0.1, None), (3, 29 * S, 0.2, None)],
        [(1, 45 * S, 9.0, None), (2, 33 * S, 0.1, None), (3, 40 * S, 9.0, None), (1, 46 * S, 0.1, None)],
        [(1, 60 * S, 9.0, None), (2, 50 * S, 7.0, None), (4, 48 * S, 0.1, None), (4, 60 * S, 9.0, None)],
    ]
    early, full = os.path.join(scratch, "early"), os.path.join(scratch, "full")
    os.mkdir(early), os.mkdir(full)
    for n, rows in enumerate(batches):
        feed(full, n, rows)
        if n < stop:
            feed(early, n, rows)
    detect = lambda folder, **more: stream_quiet(stream(spark, folder), ["k"], "ts", "v", 1.0, 5 * S, **more)
    state, cache = os.path.join(scratch, "state"), os.path.join(scratch, "cache")
    config = {"threshold": 1.0, "min_silence": 5.0, "margin": 0.0}
    first = spark.createDataFrame(emitted(spark, detect(early), f"early_{stop}", state), "k long, start_us long, end_us long")
    name = F.col("k").cast("string")
    runs = resume.open_runs(spark, state, ["k"])
    assert {r.k: r.last_us for r in runs.collect()}[1] == max(t for b in batches[:stop] for k, t, *_ in b if k == 1)
    resume.store_probes(first.limit(0), runs, cache, config, name)
    resume.store_probes(first, runs, cache, config, name)
    small = os.path.join(scratch, "small")
    compact_interval_cache(spark, cache, small)
    assert spark.read.parquet(small).count() == runs.count() + first.count() < spark.read.parquet(cache).count()

    asked = spark.createDataFrame([(str(k), None) for k in range(1, 5)], "source string, source_size long")
    asked = asked.withColumn("source_mtime", F.timestamp_micros(F.lit(0)))
    known = resume.stored_runs(spark, small, asked, config, {"k": F.col("source").cast("long")})
    rows = resume.after_probe(stream(spark, full), known, ["k"], "ts")
    later = stream_quiet(rows, ["k"], "ts", "v", 1.0, 5 * S, initial_state=known)
    got = emitted(spark, later, f"later_{stop}", os.path.join(scratch, "other"))
    before = read_interval_cache(spark, small, asked, config)
    got += [(int(r.source), r.start_us, r.end_us) for r in before.collect()]
    whole = spark.createDataFrame([r[:3] for b in batches for r in b], "k long, at long, v double")
    assert sorted(got) == sorted((r.k, r.start_us, r.end_us) for r in detect_quiet(whole, ["k"], "at", "v", 1.0, 5 * S).collect())


@pytest.mark.parametrize("late", [False, True])
def test_batches_are_written_once(spark, scratch, late):
    """A hook fails in the second batch, before or after it is stored; the restarted query has no row twice."""
    from pyspark.errors import StreamingQueryException

    from lullmap.streaming.hooks import read_once, written_once

    src, state, out = (os.path.join(scratch, x) for x in ("in", "state", "out"))
    os.mkdir(src)
    for n in range(3):
        feed(src, n, [(k, n * S, float(k), None) for k in range(5)])
    rows = stream(spark, src).select("k", "at")
    tries = []

    def hook(batch, number):
        tries.append((number, batch.count()))
        if number == 1 and [n for n, _ in tries].count(1) == 1:
            raise RuntimeError("stopped here")

    for expected in (True, False):
        q = written_once(rows, out, "q", hook).option("checkpointLocation", state).start()
        try:
            q.processAllAvailable()
            assert not expected
        except StreamingQueryException:
            assert expected
            got = read_once(spark, out, rows.schema)
            assert sorted({r.batch for r in got.collect()}) == [0]
        finally:
            q.stop()
        if late:
            # What a try that never came to its ledger left behind is not read.
            spark.range(3).selectExpr("id AS k", "id AS at").write.parquet(f"{out}/rows/query=q/batch=7{int(expected)}")
    assert tries == [(0, 5), (1, 5), (1, 5), (2, 5)]
    got = sorted((r.k, r.at) for r in read_once(spark, out, rows.schema).collect())
    assert got == sorted((k, n * S) for n in range(3) for k in range(5))
