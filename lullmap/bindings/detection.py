"""Detection, interval algebra, envelopes and sweeps."""

from __future__ import annotations

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
    query,
    samples,
    sql_keep,
    sql_margin,
    sql_merge,
    sql_quiet,
    table,
    user_ends,
    with_,
)
from lullmap.operators import envelope as env
from lullmap.operators import intervals as iv
from lullmap.operators import quiet as qt
from lullmap.operators import summary, sweep
from lullmap.plans.blocks import interval_blocks, pick_blocks

MARGIN = HOUR
IV = "SELECT user_id, start_us, end_us FROM "


def quiet_plan(spark, sf, min_len=MIN_LEN, close=True):
    """Rows, series ends, quiet intervals and the cut they share."""
    rows = samples(spark, sf)
    ends = user_ends(rows)
    blocks = pick_blocks(rows, USER, "t")
    quiet = qt.detect_quiet(
        rows, USER, "t", "value", THRESHOLD, min_len, ends if close else None, ORDER, blocks
    )
    return rows, ends, quiet, blocks


def cut_plan(spark, sf, min_len=MIN_LEN, margin=MARGIN):
    """``quiet_plan`` with the margin applied, and the keep intervals."""
    rows, ends, quiet, blocks = quiet_plan(spark, sf, min_len)
    quiet, blocks = interval_blocks(quiet, USER, "start_us", blocks)
    cut = iv.apply_margin(quiet, USER, margin, ends, blocks)
    return rows, ends, cut, iv.keep_intervals(cut, ends, USER, blocks=blocks), blocks


def sql_cut(min_len=MIN_LEN, margin=MARGIN):
    return [S, ENDS, sql_quiet(min_len=min_len), sql_margin(margin), sql_keep()]


@query("detect_quiet", with_(S, ENDS, sql_quiet(), then=IV + "quiet"))
def detect_quiet(spark, sf):
    return quiet_plan(spark, sf)[2]


@query("detect_quiet_open", with_(S, sql_quiet(close=False), then=IV + "quiet"))
def detect_quiet_open(spark, sf):
    """Without series ends the trailing run is dropped."""
    return quiet_plan(spark, sf, close=False)[2]


@query("detect_quiet_db", with_(S, ENDS, sql_quiet("500 * pow(10, -20 / 20.0)", 60_000_000), then=IV + "quiet"))
def detect_quiet_db(spark, sf):
    rows = samples(spark, sf)
    scaled = rows.withColumn("level", F.col("value") / 500)
    return qt.detect_quiet_db(scaled, USER, "t", "level", -20.0, 60.0, user_ends(rows), ORDER)


@query(
    "detect_gaps",
    with_(
        S,
        then=f"""SELECT * FROM (SELECT user_id, t AS start_us,
        lead(t) OVER (PARTITION BY user_id ORDER BY t) AS end_us FROM s) WHERE end_us - start_us > {DAY}""",
    ),
)
def detect_gaps(spark, sf):
    return qt.detect_gaps(samples(spark, sf), USER, "t", DAY)


@query(
    "activity_sessions",
    with_(
        S,
        f"""a AS (SELECT user_id, t, sum(CASE WHEN t - p > {12 * HOUR} OR p IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g
        FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM s))""",
        then="SELECT user_id, min(t) AS start_us, max(t) AS end_us, count(*) AS rows FROM a GROUP BY user_id, g",
    ),
)
def activity_sessions(spark, sf):
    return qt.activity_sessions(samples(spark, sf), USER, "t", 12 * HOUR)


def spans(spark, sf, hours=10):
    """Overlapping intervals: every event lasts ``hours``."""
    return samples(spark, sf).select(
        "user_id", F.col("t").alias("start_us"), (F.col("t") + hours * HOUR).alias("end_us")
    )


SPANS = f"spans AS (SELECT user_id, t AS start_us, t + {10 * HOUR} AS end_us FROM s)"


@query("merge_intervals", with_(S, SPANS, sql_merge("spans", "m"), then=IV + "m"))
def merge_intervals(spark, sf):
    return iv.merge_intervals(spans(spark, sf), USER)


@query("merge_intervals_gap", with_(S, SPANS, sql_merge("spans", "m", f">= {2 * HOUR}"), then=IV + "m"))
def merge_intervals_gap(spark, sf):
    return iv.merge_intervals(spans(spark, sf), USER, min_gap_us=2 * HOUR)


@query(
    "apply_margin_shrink",
    with_(S, ENDS, sql_quiet(), sql_margin(MARGIN), then=IV + "margined"),
)
def apply_margin_shrink(spark, sf):
    return cut_plan(spark, sf)[2]


@query(
    "apply_margin_grow",
    with_(S, ENDS, sql_quiet(), sql_margin(-6 * HOUR), then=IV + "margined"),
)
def apply_margin_grow(spark, sf):
    return cut_plan(spark, sf, margin=-6 * HOUR)[2]


@query("keep_intervals", with_(*sql_cut(), then=IV + "keep"))
def keep_intervals(spark, sf):
    return cut_plan(spark, sf)[3]


@query(
    "keep_intervals_floor",
    with_(S, ENDS, sql_quiet(), sql_keep("quiet", floor=6 * HOUR), then=IV + "keep"),
)
def keep_intervals_floor(spark, sf):
    """Keeps under six hours go, closer ones are joined."""
    _, ends, quiet, blocks = quiet_plan(spark, sf)
    return iv.keep_intervals(quiet, ends, USER, 6 * HOUR, blocks)


@query(
    "keep_intervals_invalid",
    with_(
        S,
        f"ends AS (SELECT user_id, max(t) - {29 * DAY + 12 * HOUR} AS end_us FROM s GROUP BY user_id)",
        then="SELECT user_id, end_us, 'end is not positive' AS reason FROM ends WHERE end_us <= 0",
    ),
)
def keep_intervals_invalid(spark, sf):
    ends = user_ends(samples(spark, sf))
    return iv.invalid_ends(ends.withColumn("end_us", F.col("end_us") - (29 * DAY + 12 * HOUR)), USER)


@query(
    "split_long",
    with_(
        *sql_cut(),
        then=f"""SELECT user_id, start_us + k * {6 * HOUR} AS start_us, least(end_us, start_us + (k + 1) * {6 * HOUR}) AS end_us
        FROM (SELECT *, unnest(range(0, ((end_us - start_us - 1) // {6 * HOUR} + 1)::BIGINT)) AS k FROM keep)""",
    ),
)
def split_long(spark, sf):
    return iv.split_long(cut_plan(spark, sf)[3], 6 * HOUR)


@query(
    "chunk_intervals",
    with_(
        S,
        "i AS (SELECT event_type, t AS start_us, t + 1000000 * (1 + event_id % 50) AS end_us FROM s)",
        """c AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, sum(end_us - start_us) OVER (PARTITION BY event_type) AS total,
        row_number() OVER (PARTITION BY event_type ORDER BY start_us, end_us) AS pos FROM i)""",
        """z AS (SELECT *, greatest(5, least(40, CASE WHEN n > 200 THEN greatest(5, 8000 // n)
        WHEN n > 100 AND total > 3600000000 THEN greatest(5, 4000 // n) ELSE 40 END)) AS size FROM c)""",
        then="""SELECT event_type, ((pos - 1) // size)::BIGINT AS chunk, min(start_us) AS start_us, arg_max(end_us, pos) AS end_us,
        count(*) AS intervals, sum(end_us - start_us)::BIGINT AS total_us FROM z GROUP BY 1, 2""",
    ),
)
def chunk_intervals(spark, sf):
    marks = samples(spark, sf).select(
        "event_type",
        F.col("t").alias("start_us"),
        (F.col("t") + 1_000_000 * (1 + F.col("event_id") % 50)).alias("end_us"),
    )
    return iv.chunk_intervals(marks, ["event_type"])


VIEW, SPAN, WIDTH = 5 * DAY, 10 * DAY, 800


@query(
    "project_to_buckets",
    with_(
        *sql_cut(),
        f"""v AS (SELECT user_id, greatest({VIEW}, start_us) AS start_us, least({VIEW + SPAN}, end_us) AS end_us FROM keep
        WHERE end_us > {VIEW} AND start_us < {VIEW + SPAN})""",
        f"""x AS (SELECT *, (start_us - {VIEW}) * {WIDTH} // {SPAN} AS l, (end_us - {VIEW}) * {WIDTH} // {SPAN} AS r FROM v)""",
        then=f"""SELECT user_id, start_us, end_us, l AS x_left, CASE WHEN l = r THEN least({WIDTH}, l + 1) ELSE r END AS x_right FROM x""",
    ),
)
def project_to_buckets(spark, sf):
    return iv.project_to_buckets(cut_plan(spark, sf)[3], VIEW, SPAN, WIDTH)


@query(
    "project_to_buckets_snapped",
    with_(
        *sql_cut(),
        f"""v AS (SELECT user_id, greatest({VIEW}, start_us) AS start_us, least({VIEW + SPAN}, end_us) AS end_us FROM keep
        WHERE end_us > {VIEW} AND start_us < {VIEW + SPAN})""",
        f"""x AS (SELECT *, round_even((start_us - {VIEW}) / {SPAN}.0 * 60, 0)::BIGINT * {WIDTH} // 60 AS l,
        round_even((end_us - {VIEW}) / {SPAN}.0 * 60, 0)::BIGINT * {WIDTH} // 60 AS r FROM v)""",
        then=f"""SELECT user_id, start_us, end_us, least({WIDTH}, l) AS x_left,
        CASE WHEN l = r THEN least({WIDTH}, l + 1) ELSE r END AS x_right FROM x""",
    ),
)
def project_to_buckets_snapped(spark, sf):
    return iv.project_to_buckets(cut_plan(spark, sf)[3], VIEW, SPAN, WIDTH, 60)


@query(
    "view_window",
    with_(
        *sql_cut(),
        then=f"""SELECT user_id, greatest({VIEW}, start_us) AS start_us, least({VIEW + SPAN}, end_us) AS end_us FROM keep
        WHERE end_us > {VIEW} AND start_us < {VIEW + SPAN}""",
    ),
)
def view_window(spark, sf):
    return iv.view_window(cut_plan(spark, sf)[3], VIEW, VIEW + SPAN)


@query(
    "interval_totals",
    with_(
        *sql_cut(),
        then="""SELECT user_id, e.end_us AS span_us, count(k.start_us) AS intervals,
        coalesce(sum(k.end_us - k.start_us), 0)::BIGINT AS total_us,
        CASE WHEN e.end_us > 0 THEN coalesce(sum(k.end_us - k.start_us), 0) / e.end_us END AS share
        FROM ends e LEFT JOIN keep k USING (user_id) GROUP BY user_id, e.end_us""",
    ),
)
def interval_totals(spark, sf):
    _, ends, _, keep, _ = cut_plan(spark, sf)
    return iv.interval_totals(keep, USER, ends)


def envelope_sql(source, key, order, value, buckets):
    return f"""WITH j AS (SELECT {key}, abs({value}) AS a,
      row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS j, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
    b AS (SELECT {key}, n, unnest(range(0, least(n, {buckets}))) AS bucket FROM (SELECT DISTINCT {key}, n FROM j))
    SELECT b.{key}, b.bucket::INTEGER AS bucket, max(a) AS peak FROM b JOIN j ON j.{key} = b.{key} AND CASE WHEN b.n <= {buckets}
      THEN j.j = b.bucket ELSE j.j >= b.bucket * b.n // {buckets} AND j.j < (b.bucket + 1) * b.n // {buckets} END GROUP BY 1, 2"""


@query(
    "envelope",
    envelope_sql(
        f"(SELECT *, epoch_us(ts) - {ORIGIN} AS t FROM events)", "user_id", "t, event_id", "value", 24
    ),
)
def envelope(spark, sf):
    return env.envelope(samples(spark, sf), USER, ORDER, "value", 24)


def vector_samples(spark, sf):
    """Embeddings as short signals: one row per component."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode("embedding").alias("i", "v")
    ).withColumn("v", F.col("v").cast("double"))


VECTORS = """(SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"""


@query("envelope_signal", envelope_sql(VECTORS, "vec_id", "i", "v", 10))
def envelope_signal(spark, sf):
    return env.envelope(vector_samples(spark, sf), ["vec_id"], ["i"], "v", 10)


@query(
    "below_threshold_runs",
    f"""WITH e AS (SELECT vec_id, i, abs(v) AS p FROM {VECTORS}),
    x AS (SELECT vec_id, unnest(range(0, 24)) AS x FROM embeddings),
    c AS (SELECT x.vec_id, x.x, max(p) AS p FROM x JOIN e ON e.vec_id = x.vec_id AND e.i >= x.x * 64 // 24
      AND e.i < greatest(x.x * 64 // 24 + 1, (x.x + 1) * 64 // 24) GROUP BY 1, 2),
    b AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id ORDER BY x) AS g FROM c WHERE p < 0.15)
    SELECT vec_id, min(x) AS x_left, max(x) + 1 AS x_right FROM b GROUP BY vec_id, g""",
)
def below_threshold_runs(spark, sf):
    peaks = vector_samples(spark, sf).select("vec_id", F.col("i").alias("bucket"), F.abs("v").alias("peak"))
    return qt.below_threshold_runs(peaks, ["vec_id"], 0.15, 24)


@query(
    "view_buckets",
    f"""WITH e AS (SELECT vec_id, i AS bucket, abs(v) AS peak, 1000000 * (10 + vec_id % 7) AS d FROM {VECTORS})
    SELECT vec_id, bucket::INTEGER AS bucket, peak FROM e WHERE bucket >= floor(2500000 * 64 / d)
      AND bucket < least(64, greatest(floor(2500000 * 64 / d) + 1, ceil(7300000 * 64 / d)))""",
)
def view_buckets(spark, sf):
    peaks = vector_samples(spark, sf).select("vec_id", F.col("i").alias("bucket"), F.abs("v").alias("peak"))
    lengths = table(spark, sf, "embeddings").select(
        "vec_id",
        (F.lit(1_000_000) * (10 + F.col("vec_id") % 7)).alias("end_us"),
        F.size("embedding").alias("n_peaks"),
    )
    return iv.view_buckets(peaks, 2_500_000, 7_300_000, lengths, ["vec_id"])


SUMMARY = """SELECT e.user_id, CASE WHEN e.end_us > 0 THEN e.end_us END AS duration_us, size_bytes,
  coalesce(qc, 0) AS quiet_count, coalesce(qu, 0)::BIGINT AS quiet_us, coalesce(kc, 0) AS keep_count, coalesce(ku, 0)::BIGINT AS keep_us,
  round(100.0 * coalesce(qu, 0)::DOUBLE / nullif(e.end_us, 0), 4) AS quiet_pct, round(100.0 * coalesce(ku, 0)::DOUBLE / nullif(e.end_us, 0), 4) AS keep_pct,
  CASE WHEN ku > 0 THEN floor(size_bytes * (ku::DOUBLE / e.end_us) * 0.4)::BIGINT END AS est_low_bytes,
  CASE WHEN ku > 0 THEN floor(size_bytes * (ku::DOUBLE / e.end_us) * 0.6)::BIGINT END AS est_high_bytes
FROM ends e JOIN (SELECT user_id, count(*) * 1000003 AS size_bytes FROM s GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS qc, sum(end_us - start_us) AS qu FROM margined GROUP BY user_id) USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS kc, sum(end_us - start_us) AS ku FROM keep GROUP BY user_id) USING (user_id)"""


@query("cut_summary", with_(*sql_cut(), then=SUMMARY))
def cut_summary(spark, sf):
    """The flagship: what would be cut from every series, and what would be left."""
    result = planned_summary(spark, sf)
    return result.withColumns({c: F.round(c, 4) for c in ("quiet_pct", "keep_pct")})


def planned_summary(spark, sf):
    rows, ends, quiet, blocks = quiet_plan(spark, sf)
    cut = iv.apply_margin(quiet, USER, MARGIN, ends, blocks)
    plan = iv.cut_plan(cut, ends, USER, blocks=blocks)
    series = rows.groupBy("user_id").agg(
        F.max("t").alias("end_us"), (F.count(F.lit(1)) * 1_000_003).alias("size_bytes")
    )
    return summary.plan_summary(plan, series, USER)


def sql_clock(us):
    s = f"({us} // 1000000)"
    return f"""CASE WHEN {s} >= 86400 THEN ({s} // 86400) || ':' ELSE '' END || printf('%02d:%02d:%02d', {s} % 86400 // 3600, {s} % 3600 // 60, {s} % 60)"""


def sql_bytes(b):
    steps = [f"WHEN {b} < {1024.0 ** (i + 1)} THEN printf('%.1f {u}', {b}::DOUBLE / {1024.0 ** i})" for i, u in enumerate(("B", "KB", "MB", "GB", "TB"))]
    return f"CASE {' '.join(steps)} END"


@query(
    "cut_report",
    with_(
        *sql_cut(),
        then=f"""SELECT user_id, {sql_clock('duration_us')} AS duration_text, {sql_clock('quiet_us')} AS quiet_text,
          {sql_clock('keep_us')} AS keep_text, {sql_bytes('size_bytes')} AS size_text FROM ({SUMMARY})""",
    ),
)
def cut_report(spark, sf):
    """The summary as text for people."""
    told = summary.cut_report(planned_summary(spark, sf))
    return told.select("user_id", "duration_text", "quiet_text", "keep_text", "size_text")


GRID = [
    (30.0, DAY, HOUR),
    (60.0, DAY, HOUR),
    (60.0, 12 * HOUR, HOUR),
    (60.0, 12 * HOUR, -2 * HOUR),
    (90.0, 2 * DAY, 0),
]


def sweep_sql():
    """Each grid point on its own, the plain way."""
    parts = []
    for i, (threshold, min_len, margin) in enumerate(GRID):
        parts += [
            sql_quiet(threshold, min_len, name=f"q{i}"),
            sql_margin(margin, f"q{i}", f"m{i}"),
            sql_keep(f"m{i}", f"k{i}"),
        ]
    total = lambda name: (
        f"(SELECT count(*) FROM {name}), coalesce((SELECT sum(end_us - start_us) FROM {name}), 0)::BIGINT"
    )
    rows = " UNION ALL ".join(
        f"SELECT {t}::DOUBLE, {m}::BIGINT, {g}::BIGINT, {total(f'm{i}')}, {total(f'k{i}')}, (SELECT sum(end_us) FROM ends)::BIGINT"
        for i, (t, m, g) in enumerate(GRID)
    )
    names = "threshold, min_len_us, margin_us, quiet_count, quiet_us, keep_count, keep_us, span_us"
    return with_(S, ENDS, *parts, then=f"SELECT * FROM ({rows}) x({names})")


@query("parameter_sweep", sweep_sql())
def parameter_sweep(spark, sf):
    rows = samples(spark, sf)
    return sweep.sweep_totals(
        sweep.parameter_sweep(rows, USER, "t", "value", GRID, user_ends(rows), order=ORDER)
    )


@query(
    "signal_stats",
    f"""SELECT vec_id, count(*) AS samples, round(sqrt(avg(v * v)), 6) AS rms, round(avg(v), 6) AS mean
    FROM {VECTORS} GROUP BY vec_id""",
)
def signal_stats(spark, sf):
    stats = env.signal_stats(vector_samples(spark, sf), ["vec_id"], "v")
    return stats.withColumns({c: F.round(c, 6) for c in ("rms", "mean")})


@query(
    "dominant_frequency",
    f"""WITH x AS (SELECT vec_id, i // 32 AS w, i % 32 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (i % 32) / 31)) AS v FROM {VECTORS}),
    p AS (SELECT vec_id, w, k, pow(sum(v * cos(2 * pi() * k * j / 32)), 2) + pow(sum(v * sin(2 * pi() * k * j / 32)), 2) AS p
      FROM x, range(1, 17) AS r(k) GROUP BY ALL),
    t AS (SELECT vec_id, k, sum(p) AS p FROM p GROUP BY ALL)
    SELECT vec_id, k * 64.0::DOUBLE / 32 AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS n FROM t) WHERE n = 1""",
)
def dominant_frequency(spark, sf):
    """Every vector in two windows, whose powers are summed."""
    return env.dominant_frequency(vector_samples(spark, sf), ["vec_id"], ["i"], "v", 64.0, window=32)
