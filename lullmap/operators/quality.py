"""Quality gates: completeness, agreement between sources, reuse of earlier results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lullmap.operators.intervals import END, START
from lullmap.plans.blocks import Blocks, pick_blocks, positions

# Fixed values of the gates.
MIN_ROW_RATIO = 0.5
DRIFT_FLOOR_S, DRIFT_CEILING_S, DRIFT_SHARE = 0.15, 2.0, 0.02
DURATION_SLACK_S = 1.0
MIN_BYTES = 1024
START_TOLERANCE_US = 50_000
INTERVAL_TOLERANCE = 1e-9
SOURCE_FIELDS = ("path", "size", "mtime_ns", "head_tail_hash")
CONFIG_FIELDS = ("threshold", "min_silence", "margin")


def size_floor(df: DataFrame, size: str = "size", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Drop artifacts below a byte floor."""
    return df.filter(F.col(size) >= min_bytes)


def completeness_verdict(rows: Column, seconds: Column, rate: Column) -> Column:
    """``fail`` below half the rows the rate promises; ``skipped`` when a side is unknown."""
    expected = seconds * rate
    known = rows.isNotNull() & (seconds > 0) & (expected > 0)
    return (
        F.when(F.coalesce(known, F.lit(False)) & (rows < expected * MIN_ROW_RATIO), "fail")
        .when(F.coalesce(known, F.lit(False)), "pass")
        .otherwise("skipped")
    )


def completeness(
    df: DataFrame, keys: Sequence[str], ts: str, rates: DataFrame
) -> DataFrame:
    """Check each series' row count against its span and nominal ``rate`` per second."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), ((F.max(ts) - F.min(ts)) / F.lit(1e6)).alias("seconds")
    )
    return rates.join(counted, list(keys), "left").withColumn(
        "verdict", completeness_verdict(F.col("rows"), F.col("seconds"), F.col("rate"))
    )


def allowed_drift(length: Column, ceiling: float = DRIFT_CEILING_S) -> Column:
    """Two percent of the length within a floor and a ceiling."""
    return F.least(F.lit(ceiling), F.greatest(F.lit(DRIFT_FLOOR_S), length * DRIFT_SHARE))


def ends_agree(
    tracks: DataFrame, keys: Sequence[str], kind: str = "kind", kinds: tuple[str, str] = ("video", "audio")
) -> DataFrame:
    """Do the two tracks of a part end together?

    ``tracks`` holds ``start_s``, ``duration_s`` and ``measured_s`` per kind. Without a
    declared duration on either side both measured lengths are compared instead; lengths
    that are missing or not positive fail.
    """

    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col(kind) == name, F.col(c))).alias(f"{name}_{c}")

    fields = ("start_s", "duration_s", "measured_s")
    sides = tracks.groupBy(*keys).agg(*[of(k, c) for k in kinds for c in fields])
    a, b = kinds
    declared = F.col(f"{a}_duration_s").isNotNull() & F.col(f"{b}_duration_s").isNotNull()

    def end(k: str) -> Column:
        own = F.col(f"{k}_duration_s") + F.coalesce(f"{k}_start_s", F.lit(0.0))
        measured = F.col(f"{k}_measured_s")
        return F.when(declared, own).otherwise(F.when(measured > 0, measured))

    return (
        sides.withColumns({"end_a": end(a), "end_b": end(b)})
        .withColumn(
            "agree",
            F.coalesce(
                F.abs(F.col("end_a") - F.col("end_b"))
                <= allowed_drift(
                    F.when(
                        F.col("end_a").isNotNull() & F.col("end_b").isNotNull(),
                        F.greatest("end_a", "end_b"),
                    )
                ),
                F.lit(False),
            ),
        )
        .select(*keys, "end_a", "end_b", "agree")
    )


def duration_verdict(actual: Column, expected: Column, slack: float = DURATION_SLACK_S) -> Column:
    """True when the lengths agree within two percent, bounded; unknown is false."""
    close = F.abs(actual - expected) <= F.when(expected.isNotNull(), allowed_drift(expected, slack))
    return F.coalesce(close, F.lit(False))


def duration_ok(
    parts: DataFrame, actual: str = "actual_s", expected: str = "expected_s", slack: float = DURATION_SLACK_S
) -> DataFrame:
    """Add ``duration_ok``."""
    return parts.withColumn("duration_ok", duration_verdict(F.col(actual), F.col(expected), slack))


def reusable_parts(
    parts: DataFrame, tracks: DataFrame | None, keys: Sequence[str], min_bytes: int = MIN_BYTES
) -> DataFrame:
    """Can a part be reused? Adds ``reusable`` and the first failing ``reason``.

    ``parts`` holds ``size``, ``expected_s``, ``actual_s``, ``rows`` and ``rate``; what
    cannot be shown to be fine is not reused.
    """
    judged = parts
    agree = F.lit(True)
    if tracks is not None:
        verdicts = ends_agree(tracks, keys).select(*keys, F.col("agree").alias("__agree"))
        judged = parts.join(verdicts, list(keys), "left")
        agree = F.coalesce("__agree", F.lit(False))
    large = F.coalesce(F.col("size") >= min_bytes, F.lit(False))
    reason = (
        F.when(~large, "size")
        .when(~duration_verdict(F.col("actual_s"), F.col("expected_s")), "duration")
        .when(
            completeness_verdict(F.col("rows"), F.col("actual_s"), F.col("rate")) == "fail",
            "completeness",
        )
        .when(~agree, "ends")
    )
    return judged.withColumns({"reason": reason, "reusable": reason.isNull()}).drop("__agree")


def starts_agree(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    series: DataFrame | None = None,
    tol_us: int = START_TOLERANCE_US,
    horizon_us: int | None = None,
    pad_us: int = 0,
    start: str = START,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Do two detections of the same series start the same intervals?

    Counts must match and, rank by rank, starts must lie within ``tol_us``. With a
    ``horizon_us`` what starts from there on is ignored on side ``b``, and on side ``a`` the
    last ``pad_us`` before it too. Series of ``series`` without intervals on either side agree.
    """
    if horizon_us is not None:
        b = b.filter(F.col(start) < horizon_us)
        if pad_us < horizon_us:
            a = a.filter(F.col(start) < horizon_us - max(0, pad_us))

    def ranked(side: DataFrame, name: str) -> DataFrame:
        cut = blocks or pick_blocks(side, keys, start)
        return positions(side.select(*keys, start), keys, [start], cut, "rank").withColumnRenamed(
            start, name
        )

    pairs = ranked(a, "__a").join(ranked(b, "__b"), [*keys, "rank"], "full_outer")
    close = F.coalesce(F.abs(F.col("__a") - F.col("__b")) <= tol_us, F.lit(False))
    verdicts = pairs.groupBy(*keys).agg(
        F.count("__a").alias("count_a"), F.count("__b").alias("count_b"), F.bool_and(close).alias("agree")
    )
    if series is None:
        return verdicts
    return (
        series.select(*keys).distinct().join(verdicts, list(keys), "left")
        .na.fill(0, ["count_a", "count_b"])
        .na.fill(True, ["agree"])
    )


def same_intervals(a: Column, b: Column, tol: float = INTERVAL_TOLERANCE) -> Column:
    """Arrays of (start, end) structs of equal length and pairwise within ``tol``; null counts as empty."""
    empty = F.array()
    near = F.zip_with(
        a,
        b,
        lambda x, y: (F.abs(x["start"] - y["start"]) <= tol) & (F.abs(x["end"] - y["end"]) <= tol),
    )
    both = F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))
    sized = F.coalesce(F.size(a), F.lit(0)) == F.coalesce(F.size(b), F.lit(0))
    none = F.coalesce(F.size(a), F.lit(0)) == 0
    return sized & (none | F.coalesce(both, F.lit(False)))


def manifest_diff(
    current: DataFrame,
    stored: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    source_fields: Sequence[str] = SOURCE_FIELDS,
    intervals: str | None = "keep_segments",
) -> DataFrame:
    """Compare run manifests: ``fresh``, ``changed`` with the first differing field, or ``missing``."""
    old = stored.select(*keys, F.struct(*[c for c in stored.columns if c not in keys]).alias("__old"))
    both = current.join(old, list(keys), "left")
    checks = [(c, F.col(c).eqNullSafe(F.col(f"__old.{c}"))) for c in [*fields, *source_fields]]
    if intervals:
        checks.append((intervals, same_intervals(F.col(intervals), F.col(f"__old.{intervals}"))))
    changed = F.coalesce(*[F.when(~same, F.lit(name)) for name, same in checks])
    missing = F.col("__old").isNull()
    status = F.when(missing, "missing").when(changed.isNotNull(), "changed").otherwise("fresh")
    return both.select(
        *keys, status.alias("status"), F.when(~missing, changed).alias("changed_field")
    )


def cache_hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests answered by the cache.

    Both hold ``source``, ``source_size`` and the three detection parameters; requests
    also ``source_mtime``, the cache ``cached_at``. Parameters are compared as numbers;
    the cached size counts only when recorded; a cache older than its source is no hit.
    """
    stored = cache.select(*[F.col(c).alias(f"__c_{c}") for c in cache.columns])
    on = [
        F.col(c).try_cast("double") == F.col(f"__c_{c}").try_cast("double") for c in CONFIG_FIELDS
    ] + [
        F.col("source") == F.col("__c_source"),
        F.col("__c_source_size").isNull() | (F.col("__c_source_size") == F.col("source_size")),
        F.col("__c_cached_at") >= F.col("source_mtime"),
    ]
    return requests.join(stored, on, "left_semi")


RULE_KINDS = ("enum", "bool", "int", "float", "auto_or_int", "str")


def rule_errors(rules: Mapping[str, Mapping]) -> list[Column]:
    """One nullable reason per rule violation.

    A rule has ``kind`` (enum, bool, int, float, auto_or_int or str) and optionally
    ``valid``, ``min``, ``max``; values are read as text, so that "1.9" for an int is
    refused rather than floored.
    """
    errors = []
    for name, rule in rules.items():
        raw = F.col(name).cast("string")
        kind = rule["kind"]
        if kind not in RULE_KINDS:
            raise ValueError(f"{name}: unknown kind of rule {kind!r}")
        bad = F.lit(False)
        if kind == "enum":
            bad = ~raw.isin(*rule["valid"])
        elif kind == "bool":
            bad = ~F.lower(raw).isin("true", "false")
        elif kind in ("int", "float", "auto_or_int"):
            number = raw.try_cast("double")
            broken = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
            if kind != "float":
                broken = broken | (number != F.floor(number))
            outside = F.lit(False)
            if rule.get("min") is not None:
                outside = outside | (number < rule["min"])
            if rule.get("max") is not None:
                outside = outside | (number > rule["max"])
            bad = broken | outside
            if kind == "auto_or_int":
                bad = bad & (F.lower(F.trim(raw)) != "auto")
        bad = F.coalesce(bad, F.lit(True))
        if rule.get("nullable"):
            bad = bad & raw.isNotNull()
        elif kind == "str":
            bad = raw.isNull()
        errors.append(F.when(bad, F.lit(f"{name}: not a valid {kind}")))
    return errors


def validate_rows(
    df: DataFrame,
    rules: Mapping[str, Mapping],
    less_than: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """Add ``errors``: the reasons a row breaks the rules, empty for a good row.

    ``less_than`` lists pairs of columns of which the first must be below the second,
    such as a warning and a kill timeout.
    """
    crossed = [
        F.when(F.col(a) >= F.col(b), F.lit(f"{a}: must be below {b}")) for a, b in less_than
    ]
    return df.withColumn("errors", F.array_compact(F.array(*rule_errors(rules), *crossed)))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and quarantined rows with their ``errors``."""
    good = F.size("errors") == 0
    return validated.filter(good).drop("errors"), validated.filter(~good)
