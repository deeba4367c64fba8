"""Applying plans to rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullmap.bindings.common import (
    DAY,
    ENDS,
    HOUR,
    ORDER,
    S,
    USER,
    query,
    samples,
    sql_merge,
    table,
    user_ends,
    with_,
)
from lullmap.bindings.detection import SPANS, cut_plan, spans, sql_cut
from lullmap.operators import apply
from lullmap.operators.intervals import merge_intervals

INSIDE = "s.user_id = k.user_id AND s.t >= k.start_us AND s.t < k.end_us"


@query("trim", with_(*sql_cut(), then=f"SELECT s.* FROM s JOIN keep k ON {INSIDE}"))
def trim(spark, sf):
    rows, _, _, keep, _ = cut_plan(spark, sf)
    return apply.trim(rows, keep, USER, "t")


@query(
    "retime",
    with_(
        *sql_cut(),
        """o AS (SELECT *, coalesce(sum(end_us - start_us) OVER (PARTITION BY user_id ORDER BY start_us
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM keep)""",
        then=f"SELECT s.*, t - k.start_us + off AS new_ts_us FROM s JOIN o k ON {INSIDE}",
    ),
)
def retime(spark, sf):
    rows, _, _, keep, blocks = cut_plan(spark, sf)
    return apply.retime(rows, keep, USER, "t", blocks=blocks)


@query(
    "interval_join",
    with_(
        S,
        SPANS,
        then="""SELECT s.user_id, s.event_id, s.t, k.start_us, k.end_us FROM s JOIN spans k
        ON s.user_id = k.user_id AND s.t >= k.start_us AND s.t < k.end_us""",
    ),
)
def interval_join(spark, sf):
    rows = samples(spark, sf).select("user_id", "event_id", "t")
    return apply.interval_join(rows, spans(spark, sf), USER, "t", "inner")


@query(
    "interval_join_left",
    with_(
        *sql_cut(),
        then=f"""SELECT s.user_id, s.event_id, s.t, k.start_us, k.end_us FROM s LEFT JOIN keep k ON {INSIDE}""",
    ),
)
def interval_join_left(spark, sf):
    rows, _, _, keep, _ = cut_plan(spark, sf)
    return apply.interval_join(rows.select("user_id", "event_id", "t"), keep, USER, "t", "left")


@query(
    "interval_join_anti",
    with_(
        *sql_cut(),
        then=f"""SELECT s.user_id, s.event_id, s.t FROM s WHERE NOT EXISTS (SELECT 1 FROM keep k WHERE {INSIDE})""",
    ),
)
def interval_join_anti(spark, sf):
    rows, _, _, keep, _ = cut_plan(spark, sf)
    slim = rows.select("user_id", "event_id", "t")
    return apply.interval_join(slim, keep, USER, "t", "left_anti")


@query(
    "shift_origin",
    with_(
        S,
        then=f"""SELECT s.*, greatest(0, (user_id % 5 - 2) * {HOUR}) + t AS shifted_us FROM s""",
    ),
)
def shift_origin(spark, sf):
    rows = samples(spark, sf)
    offsets = rows.select("user_id").distinct().withColumn(
        "offset_us", (F.col("user_id") % 5 - 2) * HOUR
    )
    copied = rows.withColumn("shifted_us", F.col("t"))
    return apply.shift_origin(copied, offsets, USER, ["shifted_us"])


@query(
    "resample",
    with_(
        S,
        ENDS,
        f"""g AS (SELECT user_id, unnest(range(0, end_us // {6 * HOUR} + 1)) * {6 * HOUR} AS tick_us FROM ends)""",
        then="""SELECT g.user_id, tick_us, s.value FROM g ASOF JOIN s ON g.user_id = s.user_id AND g.tick_us >= s.t""",
    ),
)
def resample(spark, sf):
    rows = samples(spark, sf)
    # One microsecond past the last row, so that a tick on it counts.
    ends = user_ends(rows).withColumn("end_us", F.col("end_us") + 1)
    return apply.resample(rows, USER, "t", "value", 6 * HOUR, ORDER, ends)


@query(
    "pad_or_trim",
    with_(
        S,
        "c AS (SELECT user_id, t // 43200000000 AS cell, arg_max(value, t) AS value FROM s GROUP BY 1, 2)",
        "g AS (SELECT user_id, unnest(range(0, 40 + 10 * (user_id % 4))) AS cell FROM (SELECT DISTINCT user_id FROM s))",
        then="SELECT g.user_id, g.cell, coalesce(c.value, 0.0) AS value FROM g LEFT JOIN c USING (user_id, cell)",
    ),
)
def pad_or_trim(spark, sf):
    rows = samples(spark, sf)
    segments = rows.select("user_id").distinct().withColumn(
        "length_us", (40 + 10 * (F.col("user_id") % 4)) * 12 * HOUR
    )
    return apply.pad_or_trim(rows, segments, USER, "t", "value", 12 * HOUR, ORDER)


@query(
    "concat_parts",
    with_(
        S,
        "p AS (SELECT user_id, event_type, max(t) + 1 AS length_us FROM s GROUP BY ALL)",
        """o AS (SELECT *, coalesce(sum(length_us) OVER (PARTITION BY user_id ORDER BY event_type DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)""",
        then="""SELECT user_id, event_type, event_id, t, t + off AS new_ts_us FROM s JOIN o USING (user_id, event_type)""",
    ),
)
def concat_parts(spark, sf):
    rows = samples(spark, sf).select("user_id", "event_type", "event_id", "t")
    parts = rows.groupBy("user_id", "event_type").agg((F.max("t") + 1).alias("length_us"))
    return apply.concat_parts(rows, parts, USER, "event_type", "t", [F.desc("event_type")])


@query(
    "merge_then_trim",
    with_(
        S,
        SPANS,
        "late AS (SELECT * FROM spans WHERE start_us % 3 = 0)",
        sql_merge("late", "keep", "> 0"),
        then=f"SELECT s.user_id, s.event_id, s.t FROM s WHERE EXISTS (SELECT 1 FROM keep k WHERE {INSIDE})",
    ),
)
def merge_then_trim(spark, sf):
    """Semi join against merged intervals of any origin."""
    kept = merge_intervals(spans(spark, sf).filter(F.col("start_us") % 3 == 0), USER, touch=True)
    rows = samples(spark, sf).select("user_id", "event_id", "t")
    return apply.interval_join(rows, kept, USER, "t", "left_semi")


@query(
    "resample_rate",
    """WITH v AS (SELECT vec_id, unnest(range(0, len(embedding))) * 20000 AS t, unnest(embedding)::DOUBLE AS value FROM embeddings),
    k AS (SELECT vec_id, unnest(range(0, max(t) * 24 // 1000000 + 1)) AS k FROM v GROUP BY vec_id)
    SELECT k.vec_id, k * 1000000 // 24 AS tick_us, arg_max(value, t) AS value
    FROM k JOIN v ON k.vec_id = v.vec_id AND t * 24 <= k * 1000000 GROUP BY k.vec_id, k""",
)
def resample_rate(spark, sf):
    """Every vector as fifty samples a second, at twenty-four."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    rows = rows.select("vec_id", (F.col("i").cast("long") * 20_000).alias("t"), F.col("v").cast("double").alias("value"))
    return apply.resample_rate(rows, ["vec_id"], "t", "value", "24")
