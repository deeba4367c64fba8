"""Tables as series, and SQL fragments shared by the bindings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

USER = ["user_id"]
HOUR = 3_600_000_000
DAY = 24 * HOUR
# Series time starts with the year the events lie in.
ORIGIN = 1_704_067_200_000_000
ORDER = ["t", "event_id"]
THRESHOLD, MIN_LEN = 60.0, DAY


def query(name: str, sql: str | None = None):
    """Register a query and, if it can be stated in SQL, its oracle."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table; timestamps without zone are read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measurement rows: ``t`` in microseconds from the origin."""
    return table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", "value", (micros("ts") - ORIGIN).alias("t")
    )


def user_ends(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max("t").alias("end_us"))


S = f"s AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) - {ORIGIN} AS t FROM events)"
ENDS = "ends AS (SELECT user_id, max(t) AS end_us FROM s GROUP BY user_id)"


def sql_quiet(
    threshold=THRESHOLD, min_len=MIN_LEN, close=True, src="s", name="quiet", value="value", key="user_id", tie="event_id"
) -> str:
    """CTEs for runs below a threshold."""
    w = f"PARTITION BY {key} ORDER BY t, {tie}"
    end = "coalesce(e, end_us)" if close else "e"
    ends = f"JOIN ends USING ({key})" if close else ""
    return f"""
{name}_0 AS (SELECT {key}, t, {tie}, abs({value}) < {threshold} AS q, lead(t) OVER ({w}) AS nxt,
  coalesce(lag(abs({value}) < {threshold}) OVER ({w}), false) AS pq FROM {src}),
{name}_1 AS (SELECT *, sum(CASE WHEN q AND NOT pq THEN 1 ELSE 0 END)
  OVER ({w} ROWS UNBOUNDED PRECEDING) AS run FROM {name}_0),
{name}_2 AS (SELECT {key}, run, min(t) AS start_us,
  CASE WHEN bool_or(nxt IS NULL) THEN NULL ELSE max(nxt) END AS e FROM {name}_1 WHERE q GROUP BY {key}, run),
{name} AS (SELECT {key}, start_us, {end} AS end_us FROM {name}_2 {ends}
  WHERE {end} - start_us >= {min_len} AND {end} > start_us)"""


def sql_merge(src: str, name: str, apart: str = ">= 0", key: str = "user_id") -> str:
    """CTEs joining intervals of ``src``; a new one opens where the gap is ``apart``."""
    w = f"PARTITION BY {key} ORDER BY start_us, end_us"
    return f"""
{name}_0 AS (SELECT {key}, start_us, end_us, max(end_us) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM {src}),
{name}_1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach {apart} THEN 1 ELSE 0 END)
  OVER ({w} ROWS UNBOUNDED PRECEDING) AS grp FROM {name}_0),
{name} AS (SELECT {key}, min(start_us) AS start_us, max(end_us) AS end_us FROM {name}_1 GROUP BY {key}, grp)"""


def sql_margin(margin: int | str, src="quiet", name="margined", key="user_id") -> str:
    """CTEs for a margin, clamped to neighbours and the series."""
    w = f"PARTITION BY {key} ORDER BY start_us, end_us"
    return f"""
{name}_n AS (SELECT *, lag(end_us) OVER ({w}) AS p, lead(start_us) OVER ({w}) AS n FROM {src}),
{name}_s AS (SELECT * FROM (SELECT {name}_n.{key.replace(', ', f', {name}_n.')},
    greatest(0, start_us + ({margin}), CASE WHEN p < start_us THEN (p + start_us) // 2 ELSE 0 END) AS start_us,
    least({name}_n.end_us - ({margin}), CASE WHEN {name}_n.end_us < n THEN ({name}_n.end_us + n) // 2 ELSE {name}_n.end_us - ({margin}) END,
      ends.end_us) AS end_us
  FROM {name}_n JOIN ends USING (user_id)) WHERE start_us < end_us),
{sql_merge(f'{name}_s', name, key=key)}"""


def sql_keep(src="margined", name="keep", floor=100_000, key="user_id", ends="ends") -> str:
    """CTEs for the complement within [0, end), through a row at the end of every series."""
    w = f"PARTITION BY {key} ORDER BY start_us, end_us"
    return f"""
{name}_c AS (SELECT {key}, greatest(0, q.start_us) AS start_us, least(e.end_us, q.end_us) AS end_us
  FROM {src} q JOIN (SELECT * FROM {ends} WHERE end_us > 0) e USING ({key})),
{name}_u AS (SELECT {key}, start_us, end_us FROM {name}_c WHERE start_us < end_us
  UNION ALL SELECT {key}, end_us, end_us FROM {ends} WHERE end_us > 0),
{name}_g AS (SELECT {key}, coalesce(max(end_us) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g_start,
  start_us AS g_end FROM {name}_u),
{name}_f AS (SELECT {key}, g_start AS start_us, g_end AS end_us FROM {name}_g WHERE g_end - g_start >= {floor} AND g_start < g_end),
{sql_merge(f'{name}_f', name, f'>= {floor}' if floor else '>= 0', key)}"""


def with_(*ctes: str, then: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + then
