"""Telemetry of runs, cost estimates and streaming."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lullmap.bindings.common import (
    DAY,
    ENDS,
    HOUR,
    MIN_LEN,
    ORDER,
    ORIGIN,
    S,
    THRESHOLD,
    USER,
    micros,
    query,
    samples,
    sql_quiet,
    table,
    user_ends,
    with_,
)
from lullmap.functions import units
from lullmap.operators import summary
from lullmap.operators import telemetry as tel
from lullmap.plans.scratch import new_folder

W = "PARTITION BY user_id ORDER BY t, event_id"


@query(
    "monotone",
    with_(
        S,
        f"m AS (SELECT *, coalesce(max(value) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s)",
        then="SELECT user_id, event_id, t, value FROM m WHERE value >= top",
    ),
)
def monotone(spark, sf):
    rows = samples(spark, sf).select("user_id", "event_id", "t", "value")
    return tel.monotone(rows, USER, ORDER, "value")


@query(
    "ema",
    f"""WITH s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, CASE WHEN event_id % 6 <> 0 THEN value - 20 END AS raw FROM events),
    l AS (SELECT user_id, event_type, list(struct_pack(id := event_id, raw := greatest(0.0, raw)) ORDER BY t, event_id) AS l FROM s WHERE raw IS NOT NULL GROUP BY ALL),
    f AS (SELECT user_id, event_type, unnest(range(1, len(l) + 1)) AS n, l FROM l),
    e AS (SELECT user_id, event_type, l[n].id AS event_id,
      list_reduce(list_transform(l[1:n], lambda x: x.raw), lambda a, x: a + 0.25 * (x - a)) AS e FROM f),
    j AS (SELECT s.user_id, s.event_type, s.event_id, t, e FROM s LEFT JOIN e USING (user_id, event_type, event_id))
    SELECT user_id, event_type, event_id, round(3e-8 + last_value(e IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id
      ROWS UNBOUNDED PRECEDING), 6) AS smoothed FROM j""",
)
def ema(spark, sf):
    """Compared a little off the grid, since averages of round numbers end in exact halves."""
    rows = samples(spark, sf).withColumn(
        "raw", F.when(F.col("event_id") % 6 != 0, F.col("value") - 20)
    )
    smooth = tel.ema(rows, USER, ORDER, "raw", reset=["event_type"])
    return smooth.select(
        "user_id", "event_type", "event_id", F.round(F.col("smoothed") + 3e-8, 6).alias("smoothed")
    )


@query(
    "eta",
    with_(
        S,
        "x AS (SELECT user_id, event_id, (t - min(t) OVER (PARTITION BY user_id)) / 1e6 AS el, value / 500 AS f FROM s)",
        then="""SELECT user_id, event_id, round(el, 6) AS elapsed_s, round(CASE WHEN f > 0.01 THEN el / f - el END, 3) AS eta_s,
        round(CASE WHEN f >= 0.02 THEN el / f END, 3) AS total_s FROM x""",
    ),
)
def eta(spark, sf):
    rows = samples(spark, sf).select("user_id", "event_id", "t", (F.col("value") / 500).alias("f"))
    timed = tel.eta(rows, USER, "t", "f")
    return timed.select(
        "user_id",
        "event_id",
        F.round("elapsed_s", 6).alias("elapsed_s"),
        F.round("eta_s", 3).alias("eta_s"),
        F.round("total_s", 3).alias("total_s"),
    )


@query(
    "overall_progress",
    """WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'download' WHEN 1 THEN 'quiet' WHEN 2 THEN 'cut' ELSE 'join' END AS phase,
      least(1.0, value / 100) AS f, event_id % 3 = 0 AS dl, event_id % 5 = 0 AS hit, CASE WHEN event_id % 7 <> 0 THEN value * 60 END AS d FROM events),
    q AS (SELECT *, CASE WHEN dl THEN 0.05 ELSE 0.0 END::DOUBLE AS de, CASE WHEN hit THEN 0.1 WHEN d IS NULL OR d <= 0 THEN 0.35
      WHEN d <= 600 THEN 0.25 WHEN d <= 3600 THEN 0.3 ELSE 0.35 END::DOUBLE AS qs FROM p),
    r AS (SELECT *, least(0.75, de + qs) AS qe FROM q)
    SELECT event_id, round(CASE phase WHEN 'download' THEN de * f WHEN 'quiet' THEN de + f * (qe - de)
      WHEN 'cut' THEN qe + f * (1 - qe) * 0.9 ELSE qe + (1 - qe) * (0.9 + 0.1 * f) END, 9) AS overall FROM r""",
)
def overall_progress(spark, sf):
    n = F.col("event_id")
    phase = F.when(n % 4 == 0, "download").when(n % 4 == 1, "quiet").when(n % 4 == 2, "cut")
    rows = samples(spark, sf).select(
        "event_id",
        phase.otherwise("join").alias("phase"),
        (F.col("value") / 100).alias("fraction"),
        (n % 3 == 0).alias("is_downloaded"),
        (n % 5 == 0).alias("cache_hit"),
        F.when(n % 7 != 0, F.col("value") * 60).alias("duration_s"),
    )
    return tel.overall_progress(rows).select("event_id", F.round("overall", 9).alias("overall"))


@query(
    "throttle",
    with_(
        S,
        "l AS (SELECT user_id, list(struct_pack(t := t, id := event_id, f := event_type = 'error') ORDER BY t, event_id) AS l FROM s GROUP BY 1)",
        f"""r AS (SELECT user_id, list_reduce(list_transform(l, lambda x: struct_pack(last := x.t, kept := [x.id], f := x.f)),
          lambda a, x: CASE WHEN x.f OR x.last - a.last >= {DAY} THEN struct_pack(last := x.last, kept := list_concat(a.kept, x.kept), f := x.f) ELSE a END) AS r FROM l)""",
        then="SELECT user_id, event_id, t FROM s JOIN (SELECT unnest(r.kept) AS event_id FROM r) USING (event_id)",
    ),
)
def throttle(spark, sf):
    rows = samples(spark, sf).select(
        "user_id", "event_id", "t", (F.col("event_type") == "error").alias("error")
    )
    return tel.throttle(rows, USER, "t", DAY, "error", ORDER).drop("error")


@query(
    "stall_report",
    with_(
        S,
        f"r AS (SELECT user_id, user_id % 3 * {6 * HOUR} AS a, max(t) + user_id % 40 * {HOUR} AS z FROM s GROUP BY 1)",
        f"e AS (SELECT s.user_id, t FROM s JOIN r USING (user_id) WHERE t >= a)",
        """g AS (SELECT user_id, t AS f, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS u, false AS first FROM e
          UNION ALL SELECT user_id, a, (SELECT min(t) FROM e WHERE e.user_id = r.user_id), true FROM r)""",
        "b AS (SELECT g.user_id, f, coalesce(u, z) AS u, first, a, z FROM g JOIN r USING (user_id))",
        f"""k AS (SELECT *, CASE WHEN u - a > {400 * HOUR} THEN greatest(a + {400 * HOUR}, f) END AS c_at,
          CASE WHEN first AND u - f > {8 * HOUR} THEN f + {8 * HOUR} WHEN NOT first AND u - f > {36 * HOUR} THEN f + {36 * HOUR} END AS q_at FROM b)""",
        f"""n AS (SELECT *, least(c_at, q_at) AS hit, CASE WHEN c_at IS NOT NULL AND (q_at IS NULL OR c_at <= q_at) THEN 'ceiling'
          WHEN q_at IS NOT NULL AND first THEN 'connect' WHEN q_at IS NOT NULL THEN 'no_progress' END AS kind FROM k)""",
        then=f"""SELECT user_id, min(hit) AS breach_us, arg_min(kind, hit) AS breach, count(*) FILTER (u - f > {20 * HOUR}) AS warnings,
          min(CASE WHEN u - f > {30 * HOUR} THEN f + {30 * HOUR} END) AS kill_us, max(u - f) AS longest_us FROM n GROUP BY user_id""",
    ),
)
def stall_report(spark, sf):
    rows = samples(spark, sf)
    runs = rows.groupBy("user_id").agg(
        (F.max("t") + F.col("user_id") % 40 * HOUR).alias("seen_us"),
    ).withColumn("start_us", F.col("user_id") % 3 * (6 * HOUR))
    hours = 3600.0
    return tel.stall_report(
        rows, runs, USER, "t", 8 * hours, 36 * hours, 400 * hours, 20 * hours, 30 * hours
    )


@query(
    "telemetry_limits",
    with_(
        S,
        "m AS (SELECT *, CASE WHEN event_id % 4 <> 0 THEN value END AS u, 100 - value AS av FROM s)",
        f"n AS (SELECT *, u IS NULL AND coalesce(lag(u IS NULL) OVER ({W}), false) AS gone, coalesce(u >= 190, false) AS hard FROM m)",
        f"p AS (SELECT *, coalesce(sum(CASE WHEN gone OR hard THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM n)",
        then="""SELECT user_id, coalesce(max(u), 0) AS peak, min(CASE WHEN u >= 160 AND NOT gone AND NOT hard THEN t END) AS soft_at,
          min(CASE WHEN hard THEN t END) AS hard_at, coalesce(bool_or(u IS NOT NULL AND NOT hard AND NOT gone AND av < 10), false) AS reserve_breached
          FROM p WHERE past = 0 GROUP BY user_id""",
    ),
)
def telemetry_limits(spark, sf):
    rows = samples(spark, sf).withColumns(
        {"u": F.when(F.col("event_id") % 4 != 0, F.col("value")), "av": 100 - F.col("value")}
    )
    return tel.telemetry_limits(rows, USER, ORDER, "u", "av", 200.0, reserve=10.0)


@query(
    "tree_total",
    """WITH n AS (SELECT 'r' || r_regionkey AS node, r_regionkey * 10.0 AS m, r_regionkey AS r, -1 AS n FROM region
      UNION ALL SELECT 'n' || n_nationkey, n_nationkey + 0.5, n_regionkey, n_nationkey FROM nation
      UNION ALL SELECT 's' || s_suppkey, s_acctbal, n_regionkey, -2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0),
    k AS (SELECT s_suppkey, s_acctbal, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 4 <> 0)
    SELECT 's' || s_suppkey AS node, round(s_acctbal, 4) AS total FROM k
    UNION ALL SELECT 'n' || n_nationkey, round(n_nationkey + 0.5 + coalesce((SELECT sum(s_acctbal) FROM k WHERE s_nationkey = n_nationkey), 0), 4) FROM nation
    UNION ALL SELECT 'r' || r_regionkey, round(r_regionkey * 10.0 + (SELECT sum(n_nationkey + 0.5) FROM nation WHERE n_regionkey = r_regionkey)
      + coalesce((SELECT sum(s_acctbal) FROM k WHERE n_regionkey = r_regionkey), 0), 4) FROM region""",
)
def tree_total(spark, sf):
    """Balances summed up from suppliers over nations to regions; some suppliers unknown."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf, "region").select(
        name("r", "r_regionkey").alias("node"),
        F.lit(None).cast("string").alias("parent"),
        (F.col("r_regionkey") * 10.0).alias("m"),
    )
    nations = table(spark, sf, "nation").select(
        name("n", "n_nationkey").alias("node"),
        name("r", "n_regionkey").alias("parent"),
        (F.col("n_nationkey") + 0.5).alias("m"),
    )
    suppliers = table(spark, sf, "supplier").select(
        name("s", "s_suppkey").alias("node"),
        name("n", "s_nationkey").alias("parent"),
        F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("m"),
    )
    tree = regions.unionByName(nations).unionByName(suppliers)
    totals = tel.tree_total(tree.select("node", "m"), tree.select("node", "parent"), "node", "parent", "m")
    return totals.withColumn("total", F.round("total", 4))


def runs(spark, sf):
    """Line items as finished runs."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "segment").when(F.col("l_returnflag") == "N", "batch").otherwise("cut_then_encode").alias("method"),
        (F.col("l_extendedprice") * 100).cast("long").alias("src_bytes"),
        ((F.col("l_extendedprice") - 900) * F.col("l_quantity")).cast("long").alias("dst_bytes"),
        (F.col("l_quantity") * 60).alias("src_s"),
        (F.col("l_tax") * 10).alias("wall_s"),
        (F.col("l_discount") * 700).alias("keep_s"),
    )


RUNS = """r AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'segment' WHEN 'N' THEN 'batch' ELSE 'cut_then_encode' END AS method,
  trunc(l_extendedprice * 100)::BIGINT AS src_bytes, trunc((l_extendedprice - 900) * l_quantity)::BIGINT AS dst_bytes,
  l_quantity * 60 AS src_s, l_tax * 10 AS wall_s, l_discount * 700 AS keep_s FROM lineitem)"""


@query(
    "run_summary",
    f"""WITH {RUNS}, p AS (SELECT *, CASE WHEN src_bytes > 0 THEN 100.0 * (src_bytes - dst_bytes)::DOUBLE / src_bytes END AS pct FROM r)
    SELECT l_orderkey, l_linenumber, round(abs(pct), 4) AS change_pct, CASE WHEN pct >= 0 THEN 'reduction' WHEN pct < 0 THEN 'increase' END AS change,
    round(CASE WHEN src_s > 0 AND wall_s > 0.1 THEN src_s / wall_s END, 4) AS realtime_factor,
    CASE WHEN src_bytes < 1024 THEN printf('%.1f B', src_bytes::DOUBLE) WHEN src_bytes < 1048576 THEN printf('%.1f KB', src_bytes / 1024.0::DOUBLE)
      WHEN src_bytes < 1073741824 THEN printf('%.1f MB', src_bytes / 1048576.0::DOUBLE) ELSE printf('%.1f GB', src_bytes / 1073741824.0::DOUBLE) END AS src_text,
    trunc(wall_s)::BIGINT || 's' AS wall_text FROM p""",
)
def run_summary(spark, sf):
    report = summary.run_summary(runs(spark, sf))
    return report.select(
        "l_orderkey",
        "l_linenumber",
        F.round("change_pct", 4).alias("change_pct"),
        "change",
        F.round("realtime_factor", 4).alias("realtime_factor"),
        "src_text",
        "wall_text",
    )


@query(
    "space_estimate",
    f"""WITH {RUNS}, k AS (SELECT *, trunc(src_bytes * CASE WHEN src_s > 0 AND keep_s > 0 THEN least(1.0, keep_s / src_s) ELSE 1.0 END)::BIGINT AS keep FROM r),
    t AS (SELECT *, CASE method WHEN 'segment' THEN greatest(keep, src_bytes // 4)
        WHEN 'batch' THEN CASE WHEN keep > 0 THEN trunc(keep * 1.2::DOUBLE) ELSE trunc(src_bytes * 0.4::DOUBLE) END
        ELSE CASE WHEN keep > 0 THEN trunc(keep * 1.1::DOUBLE) ELSE trunc(src_bytes * 0.35::DOUBLE) END END::BIGINT AS typ,
      CASE method WHEN 'segment' THEN greatest(CASE WHEN keep > 0 THEN trunc(keep * 2.5::DOUBLE) ELSE trunc(src_bytes * 0.9::DOUBLE) END, trunc(src_bytes * 0.6::DOUBLE))
        WHEN 'batch' THEN CASE WHEN keep > 0 THEN trunc(keep * 2.0::DOUBLE) ELSE trunc(src_bytes * 0.7::DOUBLE) END
        ELSE CASE WHEN keep > 0 THEN trunc(keep * 1.6::DOUBLE) ELSE trunc(src_bytes * 0.6::DOUBLE) END END::BIGINT AS wor FROM k)
    SELECT l_orderkey, l_linenumber, method, typ + greatest(trunc(typ * 0.2::DOUBLE)::BIGINT, 536870912) AS typical_bytes,
      wor + greatest(trunc(typ * 0.2::DOUBLE)::BIGINT, 536870912) AS worst_bytes FROM t""",
)
def space_estimate(spark, sf):
    sized = runs(spark, sf).withColumnRenamed("src_bytes", "size_bytes")
    return summary.space_estimate(sized).select(
        "l_orderkey", "l_linenumber", "method", "typical_bytes", "worst_bytes"
    )


@query(
    "preset_comparison",
    """WITH r AS (SELECT p_brand AS preset, p_partkey AS run, p_size::DOUBLE AS time_s, trunc(p_retailprice * 10)::BIGINT AS size_bytes, 600.0 AS source_s FROM part),
    m AS (SELECT preset, median(time_s) AS time_s, arg_max(size_bytes, run) AS size_bytes FROM r GROUP BY 1),
    b AS (SELECT size_bytes AS base FROM m WHERE preset = 'Brand#3')
    SELECT preset, time_s, size_bytes, round(600.0 / time_s, 6) AS speed, round(size_bytes::DOUBLE / base, 6) AS ratio FROM m, b""",
)
def preset_comparison(spark, sf):
    tried = table(spark, sf, "part").select(
        F.col("p_brand").alias("preset"),
        F.col("p_partkey").alias("run"),
        F.col("p_size").cast("double").alias("time_s"),
        (F.col("p_retailprice") * 10).cast("long").alias("size_bytes"),
        F.lit(600.0).alias("source_s"),
    )
    table_ = summary.preset_comparison(tried, "Brand#3")
    return table_.withColumns({c: F.round(c, 6) for c in ("speed", "ratio")})


@query(
    "scaled_limits",
    f"""WITH {RUNS} SELECT l_orderkey, l_linenumber, greatest(600.0, 6 * greatest(0.0, src_s - 1500)) AS limit_s,
    round(pow(10, -(l_linenumber * 10) / 20.0), 9) AS amplitude FROM r""",
)
def scaled_limits(spark, sf):
    """Time limits and levels as columns."""
    level = units.db_to_amplitude(F.col("l_linenumber") * -10)
    limit = units.scaled_limit(F.lit(600), F.col("src_s") - 1500)
    return runs(spark, sf).select(
        "l_orderkey", "l_linenumber", limit.alias("limit_s"), F.round(level, 9).alias("amplitude")
    )


@query(
    "format_durations",
    """WITH x AS (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS s FROM events)
    SELECT event_id, concat_ws(' ', CASE WHEN s >= 86400 THEN s // 86400 || 'd' END, CASE WHEN s >= 3600 THEN s % 86400 // 3600 || 'h' END,
      CASE WHEN s >= 60 THEN s % 3600 // 60 || 'm' END, s % 60 || 's') AS elapsed,
    concat_ws(':', CASE WHEN s >= 86400 THEN (s // 86400)::VARCHAR END, printf('%02d', s % 86400 // 3600), printf('%02d', s % 3600 // 60), printf('%02d', s % 60)) AS clock,
    CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) WHEN s % 60 > 0 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%dm', s // 60) END AS hm,
    CASE WHEN s < 1024 THEN printf('%.1f B/s', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB/s', s / 1024.0::DOUBLE) ELSE printf('%.1f MB/s', s / 1048576.0::DOUBLE) END AS speed FROM x""",
)
def format_durations(spark, sf):
    """The report formats over one column of seconds."""
    s = F.bround(F.col("value") * 1000).cast("long")
    return samples(spark, sf).select(
        "event_id",
        units.fmt_elapsed(s).alias("elapsed"),
        units.fmt_clock(s).alias("clock"),
        units.fmt_hm(s).alias("hm"),
        units.fmt_speed(s).alias("speed"),
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_through(result, mode="append", saved=None):
    """Process all that is there, and read back what was emitted."""
    spark = result.sparkSession
    out, saved = new_folder(spark, "stream-out"), saved or new_folder(spark, "stream-state")
    (
        result.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", saved)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(result.schema).parquet(out)


@query(
    "stream_quiet",
    with_(
        S,
        sql_quiet(close=False),
        then=f"SELECT user_id, start_us + {ORIGIN} AS start_us, end_us + {ORIGIN} AS end_us FROM quiet",
    ),
)
def stream_quiet(spark, sf):
    from lullmap.streaming.detect import stream_quiet

    return run_through(stream_quiet(event_stream(spark, sf), USER, "ts", "value", THRESHOLD, MIN_LEN))


@query(
    "stream_resume",
    with_(
        S,
        sql_quiet(close=False),
        then=f"SELECT user_id, start_us + {ORIGIN} AS start_us, end_us + {ORIGIN} AS end_us FROM quiet",
    ),
)
def stream_resume(spark, sf):
    """A stream over the first half of the time stops; what it stored lets another go on over all rows."""
    from lullmap.sources.stores import read_interval_cache
    from lullmap.streaming import resume
    from lullmap.streaming.detect import stream_quiet

    detect = lambda rows, **more: stream_quiet(rows, USER, "ts", "value", THRESHOLD, MIN_LEN, **more)
    rows = samples(spark, sf)
    middle = rows.agg(F.call_function("div", F.min("t") + F.max("t"), F.lit(2)).alias("m")).first()["m"]
    cache, saved = new_folder(spark, "probes"), new_folder(spark, "stream-state")
    config = {"threshold": THRESHOLD, "min_silence": MIN_LEN / 1e6, "margin": 0.0}
    closed = run_through(detect(event_stream(spark, sf).filter(F.unix_micros("ts") <= middle + ORIGIN)), saved=saved)
    resume.store_probes(closed, resume.open_runs(spark, saved, USER), cache, config, F.col("user_id").cast("string"))

    asked = rows.select(F.col("user_id").cast("string").alias("source")).distinct()
    asked = asked.select("source", F.lit(None).cast("long").alias("source_size"), F.timestamp_micros(F.lit(ORIGIN)).alias("source_mtime"))
    known = resume.stored_runs(spark, cache, asked, config, {"user_id": F.col("source").cast("long")})
    later = resume.after_probe(event_stream(spark, sf), known, USER, "ts")
    before = read_interval_cache(spark, cache, asked, config)
    before = before.select(F.col("source").cast("long").alias("user_id"), "start_us", "end_us")
    return before.unionByName(run_through(detect(later, initial_state=known)))


@query(
    "stream_hooks",
    with_(
        S,
        sql_quiet(close=False),
        then=f"SELECT user_id, start_us + {ORIGIN} AS start_us, end_us + {ORIGIN} AS end_us FROM quiet",
    ),
)
def stream_hooks(spark, sf):
    """Quiet intervals through a hook per batch, whose first try fails after it has written."""
    from lullmap.streaming.detect import stream_quiet
    from lullmap.streaming.hooks import read_once, written_once

    folder, saved = new_folder(spark, "stream-once"), new_folder(spark, "stream-state")
    quiet = stream_quiet(event_stream(spark, sf), USER, "ts", "value", THRESHOLD, MIN_LEN)

    def fail(batch, number):
        raise RuntimeError("not this time")

    for hook in (fail, None):
        q = written_once(quiet, folder, "quiet", hook).option("checkpointLocation", saved).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if hook is None:
                raise
    return read_once(spark, folder, quiet.schema).drop("query", "batch")


@query(
    "stream_sessions",
    with_(
        S,
        f"""a AS (SELECT user_id, t, sum(CASE WHEN t - p > {12 * HOUR} OR p IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM s))""",
        f"w AS (SELECT user_id, min(t) + {ORIGIN} AS start_us, max(t) + {ORIGIN} AS end_us, count(*) AS rows FROM a GROUP BY user_id, g)",
        then=f"SELECT * FROM w WHERE end_us + {12 * HOUR} <= (SELECT max(t) FROM s) // 1000 * 1000 + {ORIGIN} - {HOUR}",
    ),
)
def stream_sessions(spark, sf):
    """Sessions the watermark has passed; those still open are not emitted."""
    from lullmap.streaming.detect import stream_sessions

    return run_through(stream_sessions(event_stream(spark, sf), USER, "ts", "12 hours"))


@query(
    "stream_progress",
    with_(
        S,
        "x AS (SELECT user_id, event_type AS phase, event_id, t, value / 500 AS f FROM s)",
        """m AS (SELECT *, t - min(t) OVER (PARTITION BY user_id, phase) AS el, coalesce(max(f) OVER (PARTITION BY user_id, phase ORDER BY t, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM x)""",
        """k AS (SELECT *, CASE WHEN f > 0.01 THEN greatest(0.0, el / 1e6 / f - el / 1e6) END AS raw FROM m WHERE f >= top)""",
        """l AS (SELECT user_id, phase, list(raw ORDER BY t, event_id) FILTER (raw IS NOT NULL) AS l FROM k GROUP BY ALL)""",
        """c AS (SELECT k.*, count(raw) OVER (PARTITION BY user_id, phase ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n, l FROM k JOIN l USING (user_id, phase))""",
        then=f"""SELECT user_id, phase, t + {ORIGIN} AS at_us, round(f, 9) AS fraction, round(el / 1e6, 6) AS elapsed_s,
          round(3e-5 + CASE WHEN n > 0 THEN list_reduce(l[1:n], lambda a, x: a + 0.25 * (x - a)) END, 3) AS eta_s FROM c""",
    ),
)
def stream_progress(spark, sf):
    from lullmap.streaming.monitor import stream_progress

    rows = event_stream(spark, sf).select(
        "user_id", "ts", F.col("event_type").alias("phase"), (F.col("value") / 500).alias("fraction")
    )
    out = run_through(stream_progress(rows, USER, "ts"))
    digits = {"fraction": 9, "elapsed_s": 6, "eta_s": 3}
    out = out.withColumn("eta_s", F.col("eta_s") + 3e-5)
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "stream_quiet_ends",
    with_(
        S,
        "ends AS (SELECT user_id, max(t) + 60000000 AS end_us FROM s GROUP BY user_id)",
        sql_quiet(close=False, name="closed"),
        sql_quiet(name="every"),
        then=f"""SELECT user_id, start_us + {ORIGIN} AS start_us, end_us + {ORIGIN} AS end_us FROM closed UNION
          SELECT user_id, e.start_us + {ORIGIN}, e.end_us + {ORIGIN} FROM every e JOIN ends USING (user_id, end_us)
          WHERE end_us + {HOUR} < (SELECT max(t) FROM s)""",
    ),
)
def stream_quiet_ends(spark, sf):
    """Trailing runs close at the known end of a series, once the watermark has passed it."""
    from lullmap.streaming.detect import stream_quiet

    known = user_ends(samples(spark, sf)).select(
        "user_id", (F.col("end_us") + ORIGIN + 60_000_000).alias("closes_us")
    )
    rows = event_stream(spark, sf).join(known, "user_id")
    return run_through(stream_quiet(rows, USER, "ts", "value", THRESHOLD, MIN_LEN, "closes_us"))


@query(
    "stream_stalls",
    with_(
        S,
        f"g AS (SELECT user_id, t, coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t), (SELECT max(t) FROM s) - {HOUR}) - t AS silent FROM s)",
        then=f"""SELECT user_id, 'warn' AS kind, t + {ORIGIN} AS last_event_us, 36000.0::DOUBLE AS silent_s FROM g WHERE silent > {10 * HOUR}
          UNION ALL SELECT user_id, 'kill', t + {ORIGIN}, 86400.0::DOUBLE FROM g WHERE silent > {DAY}""",
    ),
)
def stream_stalls(spark, sf):
    """Silences of ten hours and of a day, replayed in event time."""
    from lullmap.streaming.monitor import stream_stalls

    return run_through(stream_stalls(event_stream(spark, sf), USER, "ts", 36_000.0, 86_400.0, "1 hour"))
