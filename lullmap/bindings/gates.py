"""Quality gates, agreement and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from lullmap.bindings.common import ENDS, HOUR, S, USER, query, samples, table, with_
from lullmap.functions import units
from lullmap.operators import quality as q


@query("size_floor", "SELECT doc_id, n_chars FROM documents WHERE n_chars >= 1024")
def size_floor(spark, sf):
    return q.size_floor(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")


RATES = """r AS (SELECT user_id, CASE WHEN user_id % 6 = 0 THEN NULL ELSE '1000/' || (20000000 + 5000000 * (user_id % 17)) END AS ratio
  FROM (SELECT DISTINCT user_id FROM s)),
r2 AS (SELECT user_id, split_part(ratio, '/', 1)::DOUBLE / split_part(ratio, '/', 2)::DOUBLE AS rate FROM r)"""


@query(
    "completeness",
    with_(
        S,
        RATES,
        "c AS (SELECT user_id, count(*) AS rows, (max(t) - min(t)) / 1e6 AS seconds FROM s GROUP BY 1)",
        then="""SELECT user_id, rows, round(seconds, 6) AS seconds, round(rate, 9) AS rate,
        CASE WHEN rate IS NULL OR seconds <= 0 THEN 'skipped' WHEN rows < seconds * rate * 0.5 THEN 'fail' ELSE 'pass' END AS verdict
        FROM r2 JOIN c USING (user_id)""",
    ),
)
def completeness(spark, sf):
    """Rates come as ratios; some are unknown."""
    rows = samples(spark, sf)
    user = F.col("user_id")
    ratio = F.concat(F.lit("1000/"), (20_000_000 + 5_000_000 * (user % 17)).cast("string"))
    rates = rows.select("user_id").distinct().withColumn(
        "rate", units.parse_ratio(F.when(user % 6 != 0, ratio))
    )
    return q.completeness(rows, USER, "t", rates).withColumns(
        {"seconds": F.round("seconds", 6), "rate": F.round("rate", 9)}
    )


def tracks(spark, sf):
    """Line items of an order as its two tracks, by line number."""
    items = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 1, "video").otherwise("audio")
    return items.groupBy("l_orderkey", kind.alias("kind")).agg(
        F.when(F.col("l_orderkey") % 3 != 0, F.max("l_tax")).alias("start_s"),
        F.when(F.col("l_orderkey") % 5 != 0, F.max("l_quantity")).alias("duration_s"),
        (F.max("l_quantity") - 10).alias("measured_s"),
    )


TRACKS = """t AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'video' ELSE 'audio' END AS kind,
  CASE WHEN l_orderkey % 3 <> 0 THEN max(l_tax) END AS start_s, CASE WHEN l_orderkey % 5 <> 0 THEN max(l_quantity) END AS duration_s,
  max(l_quantity) - 10 AS measured_s FROM lineitem GROUP BY l_orderkey, CASE WHEN l_linenumber % 2 = 1 THEN 'video' ELSE 'audio' END),
k AS (SELECT DISTINCT l_orderkey FROM t),
j AS (SELECT k.l_orderkey, v.start_s vs, v.duration_s vd, v.measured_s vm, a.start_s s, a.duration_s d, a.measured_s m
  FROM k LEFT JOIN t v ON v.l_orderkey = k.l_orderkey AND v.kind = 'video' LEFT JOIN t a ON a.l_orderkey = k.l_orderkey AND a.kind = 'audio'),
e AS (SELECT l_orderkey, CASE WHEN vd IS NOT NULL AND d IS NOT NULL THEN vd + coalesce(vs, 0) WHEN vm > 0 THEN vm END AS end_a,
  CASE WHEN vd IS NOT NULL AND d IS NOT NULL THEN d + coalesce(s, 0) WHEN m > 0 THEN m END AS end_b FROM j),
ea AS (SELECT l_orderkey, end_a, end_b, end_a IS NOT NULL AND end_b IS NOT NULL
  AND abs(end_a - end_b) <= least(2.0, greatest(0.15, greatest(end_a, end_b) * 0.02)) AS agree FROM e)"""


@query(
    "ends_agree",
    f"WITH {TRACKS} SELECT l_orderkey, round(end_a, 6) AS end_a, round(end_b, 6) AS end_b, agree FROM ea",
)
def ends_agree(spark, sf):
    return q.ends_agree(tracks(spark, sf), ["l_orderkey"]).withColumns(
        {"end_a": F.round("end_a", 6), "end_b": F.round("end_b", 6)}
    )


def measured_parts(spark, sf):
    """Orders as parts: the price is the size, the date sets the lengths."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.col("o_totalprice").cast("long").alias("size"),
        ((key % 997 + 1) / F.lit(4.0)).alias("expected_s"),
        F.when(key % 13 != 0, (key % 997 + 1) / F.lit(4.0) + (key % 8 - 3) / F.lit(16.0)).alias("actual_s"),
        (key % 400).alias("rows"),
        F.when(key % 11 != 0, F.lit(3.0)).alias("rate"),
    )


PARTS = """p AS (SELECT o_orderkey AS l_orderkey, trunc(o_totalprice)::BIGINT AS size, (o_orderkey % 997 + 1) / 4.0::DOUBLE AS expected_s,
  CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 997 + 1) / 4.0::DOUBLE + (o_orderkey % 8 - 3) / 16.0::DOUBLE END AS actual_s,
  o_orderkey % 400 AS rows, CASE WHEN o_orderkey % 11 <> 0 THEN 3.0::DOUBLE END AS rate FROM orders)"""
CLOSE = "coalesce(abs(actual_s - expected_s) <= least(1.0, greatest(0.15, expected_s * 0.02)), false)"


@query("duration_ok", f"WITH {PARTS} SELECT l_orderkey, expected_s, actual_s, {CLOSE} AS duration_ok FROM p")
def duration_ok(spark, sf):
    parts = measured_parts(spark, sf).select("l_orderkey", "expected_s", "actual_s")
    return q.duration_ok(parts)


@query(
    "reusable_parts",
    f"""WITH {PARTS}, {TRACKS}, r AS (SELECT p.l_orderkey, CASE WHEN size < 2048 THEN 'size' WHEN NOT {CLOSE} THEN 'duration'
      WHEN rate IS NOT NULL AND actual_s > 0 AND rows < actual_s * rate * 0.5 THEN 'completeness'
      WHEN NOT coalesce(agree, false) THEN 'ends' END AS reason FROM p LEFT JOIN ea USING (l_orderkey))
    SELECT l_orderkey, reason, reason IS NULL AS reusable FROM r""",
)
def reusable_parts(spark, sf):
    judged = q.reusable_parts(measured_parts(spark, sf), tracks(spark, sf), ["l_orderkey"], 2048)
    return judged.select("l_orderkey", "reason", "reusable")


@query(
    "starts_agree",
    with_(
        S,
        f"""a AS (SELECT user_id, t // {48 * HOUR} AS d, min(t) AS start_us FROM s WHERE event_type = 'click' GROUP BY 1, 2),
        b AS (SELECT user_id, t // {48 * HOUR} AS d, min(t) AS start_us FROM s WHERE event_type = 'view' GROUP BY 1, 2)""",
        f"""ra AS (SELECT user_id, start_us, row_number() OVER (PARTITION BY user_id ORDER BY start_us) AS rank FROM a WHERE start_us < {216 * HOUR}),
        rb AS (SELECT user_id, start_us, row_number() OVER (PARTITION BY user_id ORDER BY start_us) AS rank FROM b WHERE start_us < {240 * HOUR})""",
        f"""v AS (SELECT user_id, count(ra.start_us) AS ca, count(rb.start_us) AS cb,
        bool_and(coalesce(abs(ra.start_us - rb.start_us) <= {30 * HOUR}, false)) AS ok FROM ra FULL JOIN rb USING (user_id, rank) GROUP BY user_id)""",
        then="""SELECT user_id, coalesce(ca, 0) AS count_a, coalesce(cb, 0) AS count_b, coalesce(ok, true) AS agree
        FROM (SELECT DISTINCT user_id FROM s) LEFT JOIN v USING (user_id)""",
    ),
)
def starts_agree(spark, sf):
    """Clicks against views, the first of every two days, within the first ten."""
    rows = samples(spark, sf)

    def first(kind):
        day = F.floor(F.col("t") / (48 * HOUR))
        of = rows.filter(F.col("event_type") == kind)
        return of.groupBy("user_id", day.alias("d")).agg(F.min("t").alias("start_us"))

    return q.starts_agree(first("click"), first("view"), USER, rows, 30 * HOUR, 240 * HOUR, 24 * HOUR)


FIELDS = ["method", "priority"]


def manifests(spark, sf):
    """Orders as run manifests, and a stored version in which some fields differ."""
    key = F.col("o_orderkey")
    two = lambda shift: F.array(
        F.struct((key / 8.0).alias("start"), (key / 8.0 + 1).alias("end")),
        F.struct((key / 8.0 + 2).alias("start"), (key / 8.0 + 3 + shift).alias("end")),
    )
    base = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("method"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        F.col("o_custkey").alias("size"),
        two(F.lit(0.0)).alias("keep_segments"),
    )
    stored = base.filter(key % 10 != 0).withColumns(
        {
            "priority": F.when(key % 7 == 0, F.lit("1-URGENT")).otherwise(F.col("priority")),
            "size": F.col("size") + (key % 6 == 0).cast("int"),
            "keep_segments": F.when(key % 4 == 0, two(F.lit(0.5)))
            .when(key % 9 == 0, F.slice("keep_segments", 1, 1))
            .otherwise(two(F.lit(1e-10))),
        }
    )
    return base, stored


@query(
    "manifest_diff",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN f IS NULL THEN 'fresh' ELSE 'changed' END AS status,
    CASE WHEN o_orderkey % 10 <> 0 THEN f END AS changed_field FROM (SELECT o_orderkey,
      CASE WHEN o_orderkey % 7 = 0 AND nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT' THEN 'priority'
      WHEN o_orderkey % 6 = 0 THEN 'size' WHEN o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 THEN 'keep_segments' END AS f FROM orders)""",
)
def manifest_diff(spark, sf):
    base, stored = manifests(spark, sf)
    return q.manifest_diff(base, stored, ["o_orderkey"], FIELDS, ["size"])


@query(
    "cache_hits",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0
    AND (o_orderkey % 7 = 0 OR o_orderkey % 3 <> 0) AND o_orderkey % 11 <> 0""",
)
def cache_hits(spark, sf):
    """Requests that match in parameters, size (when recorded) and age."""
    key = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("source"),
        F.col("o_custkey").alias("source_size"),
        F.lit(-30).alias("threshold"),
        F.lit(2.0).alias("min_silence"),
        F.lit("0.5").alias("margin"),
        key.alias("source_mtime"),
    )
    cache = base.filter(key % 2 == 0).select(
        "source",
        F.when(key % 7 != 0, F.col("source_size") + (key % 3 == 0).cast("int")).alias("source_size"),
        F.lit("-30.0").alias("threshold"),
        F.when(key % 5 != 0, F.lit(2)).alias("min_silence"),
        F.lit(0.50).alias("margin"),
        (key - (key % 11 == 0).cast("int")).alias("cached_at"),
    )
    return q.cache_hits(base, cache).select("o_orderkey")


RULES = {
    "c_mktsegment": {"kind": "enum", "valid": ["BUILDING", "MACHINERY", "HOUSEHOLD"]},
    "c_nationkey": {"kind": "int", "min": 3, "max": 20},
    "c_acctbal": {"kind": "float", "min": -500.0},
    "threads": {"kind": "auto_or_int", "min": 1, "max": 64},
    "size_mb": {"kind": "int", "min": 0},
}
CROSS = [("warn_s", "kill_s")]


def settings(spark, sf):
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_mktsegment",
        "c_nationkey",
        "c_acctbal",
        F.when(key % 3 == 0, "Auto").otherwise((key % 70).cast("string")).alias("threads"),
        F.when(key % 8 == 0, "1.9").otherwise(F.concat((key % 9).cast("string"), F.lit(".0"))).alias("size_mb"),
        (key % 120).alias("warn_s"),
        (key % 300).alias("kill_s"),
    )


@query(
    "validate_rows",
    """SELECT c_custkey, concat_ws('; ', CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'c_mktsegment: not a valid enum' END,
      CASE WHEN c_nationkey NOT BETWEEN 3 AND 20 THEN 'c_nationkey: not a valid int' END,
      CASE WHEN c_acctbal < -500 THEN 'c_acctbal: not a valid float' END,
      CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 70 NOT BETWEEN 1 AND 64 THEN 'threads: not a valid auto_or_int' END,
      CASE WHEN c_custkey % 8 = 0 THEN 'size_mb: not a valid int' END,
      CASE WHEN c_custkey % 120 >= c_custkey % 300 THEN 'warn_s: must be below kill_s' END) AS reasons FROM customer""",
)
def validate_rows(spark, sf):
    checked = q.validate_rows(settings(spark, sf), RULES, CROSS)
    return checked.select("c_custkey", F.concat_ws("; ", "errors").alias("reasons"))
