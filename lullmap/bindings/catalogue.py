"""Catalogues, selections and resumable batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lullmap.bindings.common import micros, query, table
from lullmap.operators import catalog as cat

NOW = dt.datetime(2003, 1, 1, tzinfo=dt.timezone.utc)


def parts(spark, sf, listing="p_brand"):
    """``part`` as a catalogue: brands or types are listings, some values unknown."""
    known = lambda c, n: F.when(F.col("p_partkey") % n != 0, F.col(c))
    return table(spark, sf, "part").select(
        F.col(listing).alias("listing"),
        F.col("p_partkey").alias("pos"),
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("video_id"),
        F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("url"),
        known("p_name", 7).alias("title"),
        known("p_size", 5).cast("double").alias("duration"),
        known("p_retailprice", 3).cast("long").alias("view_count"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") * 37 % 1009).alias("ts"),
    )


PARTS = """c AS (SELECT p_brand AS listing, p_partkey AS pos, 'v' || p_partkey AS video_id,
  'https://example.org/' || p_partkey AS url, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS title,
  CASE WHEN p_partkey % 5 <> 0 THEN p_size END::DOUBLE AS duration,
  CASE WHEN p_partkey % 3 <> 0 THEN trunc(p_retailprice) END::BIGINT AS view_count,
  CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 37 % 1009 END AS ts FROM part)"""
TYPES = PARTS.replace("p_brand AS listing", "p_type AS listing")
COLS = "listing, pos, video_id, url, title, duration, view_count, ts"
PLACE = "row_number() OVER (PARTITION BY listing ORDER BY"


@query(
    "glob_filter",
    f"""WITH {PARTS} SELECT * FROM c WHERE title IS NOT NULL AND (title LIKE '%ring%' OR title LIKE 's____ %')
    AND NOT title LIKE '%red%'""",
)
def glob_filter(spark, sf):
    return cat.glob_filter(parts(spark, sf), "title", "*RING*, +s???? *, !*red*")


@query(
    "glob_filter_exclude",
    f"""WITH {PARTS} SELECT * FROM c WHERE title IS NULL OR NOT regexp_matches(title, '^[bg].*[^a-m]$')""",
)
def glob_filter_exclude(spark, sf):
    """An exclude-only spec keeps rows without a title."""
    return cat.glob_filter(parts(spark, sf), "title", "![bg]*[!a-m]")


@query(
    "meta_filter",
    f"WITH {PARTS} SELECT * FROM c WHERE (duration IS NULL OR duration >= 20) AND (ts IS NULL OR ts >= 300)",
)
def meta_filter(spark, sf):
    return cat.meta_filter(parts(spark, sf), 20.0, 300)


@query(
    "meta_filter_since",
    """SELECT o_orderkey, epoch_us(o_orderdate) AS ordered_us FROM orders
    WHERE o_orderdate >= TIMESTAMP '2003-01-01' - INTERVAL 540 DAY AND o_totalprice >= 1000""",
)
def meta_filter_since(spark, sf):
    """Orders of the last 18 months of 30 days."""
    since = cat.parse_since("-18m", NOW)
    orders = table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    kept = cat.meta_filter(orders, 1000.0, since, "o_totalprice", "at")
    return kept.select("o_orderkey", micros("at").alias("ordered_us"))


@query(
    "select_positions",
    f"""WITH {TYPES}, r AS (SELECT *, {PLACE} duration DESC NULLS LAST, pos) AS n FROM c)
    SELECT listing, pos AS partkey, title, duration, n::INTEGER AS pos FROM r WHERE n IN (1, 3, 4, 5, 9)""",
)
def select_positions(spark, sf):
    listed = parts(spark, sf, "p_type").select("listing", F.col("pos").alias("partkey"), "title", "duration")
    order = [F.desc_nulls_last("duration"), F.asc("partkey")]
    return cat.select_positions(listed, "9,1,5-3", order, ["listing"])


def ranked_sql(order: str) -> str:
    return f"WITH {PARTS} SELECT {COLS}, {PLACE} {order}, pos) AS rank FROM c"


@query("sort_catalog_duration", ranked_sql("duration DESC NULLS LAST"))
def sort_catalog_duration(spark, sf):
    return cat.sort_catalog(parts(spark, sf), "duration")


@query("sort_catalog_views", ranked_sql("view_count DESC NULLS LAST"))
def sort_catalog_views(spark, sf):
    return cat.sort_catalog(parts(spark, sf), "views")


@query("sort_catalog_date", ranked_sql("ts DESC NULLS LAST"))
def sort_catalog_date(spark, sf):
    return cat.sort_catalog(parts(spark, sf), "date")


def undated(spark, sf):
    """No dates; every eleventh id is no number."""
    odd = F.col("pos") % 11 == 0
    return parts(spark, sf).withColumns(
        {"ts": F.lit(None).cast("long"), "video_id": F.when(odd, F.concat("video_id", F.lit("x"))).otherwise(F.col("video_id"))}
    )


@query(
    "sort_catalog_date_by_id",
    f"""WITH {PARTS}, d AS (SELECT listing, pos, CASE WHEN pos % 11 = 0 THEN video_id || 'x' ELSE video_id END AS video_id FROM c)
    SELECT *, {PLACE} CASE WHEN pos % 11 = 0 THEN 0 ELSE 1 END, CASE WHEN pos % 11 = 0 THEN pos ELSE -pos END) AS rank FROM d""",
)
def sort_catalog_date_by_id(spark, sf):
    return cat.sort_catalog(undated(spark, sf), "date").select("listing", "pos", "video_id", "rank")


@query(
    "first_n_per_listing",
    f"WITH {PARTS} SELECT {COLS} FROM (SELECT *, {PLACE} pos) AS n FROM c) WHERE n <= 50",
)
def first_n_per_listing(spark, sf):
    return cat.first_n_per_listing(parts(spark, sf))


@query(
    "latest_checkpoint",
    """WITH a AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) AS mtime_us,
      (ascii(o_orderpriority) - 49)::INTEGER AS priority FROM orders)
    SELECT o_custkey, o_orderkey, mtime_us, priority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
      ORDER BY priority, mtime_us DESC, o_orderkey) AS n FROM a) WHERE n = 1""",
)
def latest_checkpoint(spark, sf):
    """Per customer the newest of the most urgent orders."""
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        micros("o_orderdate").alias("mtime_us"),
        (F.ascii("o_orderpriority") - 49).alias("priority"),
    )
    return cat.latest_checkpoint(orders, ["o_custkey"], "mtime_us", "priority")


def orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("url"),
        "o_orderstatus",
        "o_custkey",
    )


ORDERS = """o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'u' || o_custkey END AS url, o_orderstatus, o_custkey FROM orders)"""


@query(
    "unfinished",
    f"""WITH {ORDERS} SELECT url, o_orderkey FROM o WHERE o_orderstatus = 'O' AND url IS NOT NULL
    AND url NOT IN (SELECT url FROM o WHERE o_orderstatus = 'F' AND url IS NOT NULL)""",
)
def unfinished(spark, sf):
    o = orders(spark, sf)
    wanted = o.filter(F.col("o_orderstatus") == "O").select("url", "o_orderkey")
    return cat.unfinished(wanted, o.filter(F.col("o_orderstatus") == "F"))


@query(
    "merge_completed",
    f"""WITH {ORDERS} SELECT url FROM o WHERE o_orderstatus = 'F' AND url IS NOT NULL
    UNION SELECT url FROM o WHERE o_orderstatus = 'P' AND url IS NOT NULL""",
)
def merge_completed(spark, sf):
    o = orders(spark, sf).filter(F.col("url").isNotNull())
    by = lambda status: o.filter(F.col("o_orderstatus") == status)
    return cat.merge_completed(by("F"), by("P"))


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'failed' ELSE 'open' END"


@query(
    "batch_outcome",
    f"""SELECT o_custkey % 50 AS batch, count(*) FILTER ({STATUS} = 'ok') AS ok,
    count(*) FILTER ({STATUS} = 'failed') AS failed, count(*) AS total FROM orders GROUP BY 1""",
)
def batch_outcome(spark, sf):
    return cat.batch_outcome(results(spark, sf), "batch", "status")


def results(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "failed")
    return orders(spark, sf).select(
        (F.col("o_custkey") % 50).alias("batch"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"),
        status.otherwise("open").alias("status"),
    )


@query(
    "failed_entries",
    "SELECT o_custkey % 50 AS batch, 'u' || o_orderkey AS url FROM orders WHERE o_orderstatus = 'P'",
)
def failed_entries(spark, sf):
    return cat.failed_entries(results(spark, sf), "batch", "url", "status")


@query(
    "recent_top_k",
    """WITH u AS (SELECT user_id, event_type, max(epoch_us(ts)) AS used_us FROM events GROUP BY ALL)
    SELECT user_id, event_type, used_us, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY used_us DESC, event_type) AS rank FROM u) WHERE rank <= 3""",
)
def recent_top_k(spark, sf):
    used = table(spark, sf, "events").select("user_id", "event_type", micros("ts").alias("used_us"))
    return cat.recent_top_k(used, "user_id", "event_type", "used_us", 3)


@query(
    "expand_queue",
    f"""WITH {TYPES}, q AS (SELECT p_partkey + 1 AS line_no, CASE WHEN p_partkey % 50 = 0 THEN p_type ELSE p_name END AS entry FROM part),
    r AS (SELECT listing, title, url, {PLACE} view_count DESC NULLS LAST, pos) AS rank FROM c
      WHERE (title IS NULL OR NOT title LIKE '%red%') AND (duration IS NULL OR duration >= 5))
    SELECT line_no, rank::INTEGER AS rank, title, url FROM q JOIN r ON q.entry = r.listing
    WHERE rank IN (1, 2, 4) AND entry IN (SELECT listing FROM r WHERE rank >= 4)
    UNION ALL SELECT line_no, 1::INTEGER, NULL, entry FROM q WHERE entry NOT IN (SELECT listing FROM c)""",
)
def expand_queue(spark, sf):
    """A queue of part names among which every fiftieth line names a listing."""
    return cat.expand_queue(part_queue(spark, sf), parts(spark, sf, "p_type"), "1-2,4", "views", "!*red*", 5.0)


def part_queue(spark, sf, every=50):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (key + 1).alias("line_no"),
        F.when(key % every == 0, F.col("p_type")).otherwise(F.col("p_name")).alias("entry"),
    )


@query(
    "queue_problems",
    f"""WITH {TYPES}, q AS (SELECT p_partkey + 1 AS line_no, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS entry FROM part),
    r AS (SELECT listing, count(*) FILTER (title LIKE '%a%' AND (duration IS NULL OR duration >= 50)) AS entries FROM c GROUP BY listing)
    SELECT line_no, entry, entries, CASE entries WHEN 0 THEN 'empty' ELSE 'short' END AS reason
    FROM q JOIN r ON entry = listing WHERE entries < 100000""",
)
def queue_problems(spark, sf):
    """Listings of which the filters leave nothing, or less than is asked for."""
    return cat.queue_problems(part_queue(spark, sf, 2), parts(spark, sf, "p_type"), "100000", "*a*", 50.0)
