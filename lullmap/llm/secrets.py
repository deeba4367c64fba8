"""Secret scans with multipart credential linking, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lullmap.llm.common import query, stored, table, text_of

# Code points that parts of one credential lie apart at most.
SCOPE = 200

# Pattern, group whose length counts, and its least and largest length.
BASE = {
    "assign": (
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 12,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
# Weak parts: reported only beside complementary ones.
WEAK = {
    "id": (r"""(?i)(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    "endpoint": (r"""(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+""", 0, 10),
    "opaque": (r"[A-Za-z0-9/+_-]{32,}", 0, 32),
}
KINDS = [*BASE, *WEAK]
WHO, WHAT = ["access", "id"], ["assign", "hex", "opaque"]


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind in order: characters before each since the last, its length, whether it counts."""
    pattern, group, least = (BASE | WEAK)[kind]
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    ok = lambda n: n >= least
    found = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), counted.alias("part")),
        lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["hit"]).alias("size"),
            ok(F.length(m["part"])).alias("ok"),
        ),
    )
    # The last gap has no match after it.
    found = F.slice(found, F.lit(1), F.size(found) - 1)
    nothing = F.array().cast("array<struct<kind:int,gap:int,size:int,ok:boolean>>")
    return F.when(F.rlike(text, p), found).otherwise(nothing)


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The ``parts`` with one of ``others`` within the scope, by a join on cells of one scope.

    A cell holds few parts of a kind, as none is shorter than three characters and those of a
    kind do not overlap, so the join stays linear in the parts.
    """
    cells = lambda low, high: F.explode(F.sequence((low / SCOPE).cast("long"), (high / SCOPE).cast("long")))
    left = parts.withColumn("cell", cells(F.greatest(F.col("start") - SCOPE, F.lit(0)), F.col("end") + SCOPE))
    right = others.select(
        F.col("row").alias("o_row"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), cells(F.col("start"), F.col("end")).alias("o_cell")
    )
    on = (
        (F.col("row") == F.col("o_row"))
        & (F.col("cell") == F.col("o_cell"))
        & (F.col("o_start") <= F.col("end") + SCOPE)
        & (F.col("o_end") + SCOPE >= F.col("start"))
        & ~((F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start")))
    )
    return left.join(right, on, "left_semi").drop("cell").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets per document: row, doc_id and spans (start, kind, end), kind by its place in KINDS.

    Base kinds are always reported. Weak parts are linked within a document: an opaque string
    counts beside an access identifier or login, a login beside a secret, an endpoint beside
    both, each at most ``SCOPE`` code points away and not overlapping.

    Null and empty texts have no spans. Repeated rows and null ids are scanned each for itself;
    other columns are ignored.
    """
    text = F.col("x")
    rows = docs.select("doc_id", text_of(F.col("text")).alias("x")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.flatten(F.array(*[_matches(text, k) for k in KINDS])).alias("found"),
    )
    rows = stored(rows, "matches")
    each = rows.select("row", F.posexplode("found").alias("at", "m")).select("row", "at", "m.*")
    w = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = (
        each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w))
        .filter("ok")
        .select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )
    spans = stored(spans, "spans")
    place = {k: i for i, k in enumerate(KINDS)}
    of = lambda kinds: spans.filter(F.col("kind").isin([place[k] for k in kinds]))
    who, what = of(WHO), of(WHAT)
    linked = [
        of(BASE),
        _near(of(["opaque"]), who),
        _near(of(["id"]), what),
        _near(_near(of(["endpoint"]), who), what),
    ]
    kept = linked[0]
    for more in linked[1:]:
        kept = kept.unionByName(more)
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    none = F.array().cast(grouped.schema["spans"].dataType)
    return rows.select("row", "doc_id").join(grouped, "row", "left").withColumn("spans", F.coalesce("spans", none))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def report(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    each = []
    for i, kind in enumerate(KINDS):
        pattern, group, least = (BASE | WEAK)[kind]
        p = pattern.replace("'", "''")
        ok = f"length(part) >= {least}"
        each.append(f"""SELECT doc_id, {i} AS kind, start, start + length(hit) AS e FROM (
          SELECT doc_id, hit, part, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY pos) - length(hit) AS start FROM (
            SELECT doc_id, generate_subscripts(hits, 1) AS pos, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap
            FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS parts,
              string_split_regex(t, '{p}') AS gaps FROM d))) WHERE {ok}""")
    near = lambda kinds: f"""EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.kind IN ({', '.join(str(KINDS.index(k)) for k in kinds)})
      AND o.start <= s.e + {SCOPE} AND o.e + {SCOPE} >= s.start AND NOT (o.start < s.e AND o.e > s.start))"""  # noqa: E731
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    told = f"{name} || ':' || start || ':' || e, ',' ORDER BY start, kind, e"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({' UNION ALL '.join(each)}),
    k AS (SELECT * FROM s WHERE kind < {len(BASE)} OR (kind = {KINDS.index('opaque')} AND {near(WHO)})
      OR (kind = {KINDS.index('id')} AND {near(WHAT)}) OR (kind = {KINDS.index('endpoint')} AND {near(WHO)} AND {near(WHAT)}))
    SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = {KINDS.index(b)}) AS n_{b}" for b in BASE)},
      sha256(coalesce(string_agg({told}) FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({told}), '') AS spans
    FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""


@query("op9_secret_scan", _sql())
def op9_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return report(scan(table(spark, sf, "documents")))
