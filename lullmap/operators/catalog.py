"""Catalogues of recordings: filtering, ordering, picking, batches that resume.

A catalogue row holds ``listing``, ``pos`` (order within the listing), ``video_id``,
``url``, ``title``, ``duration`` (seconds), ``view_count`` and ``ts`` (Unix seconds).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lullmap.plans.blocks import Blocks, pick_blocks, positions, spread_join

# Fixed values of the catalogue model.
SORTS = ("date", "duration", "views")
LISTING_WINDOW = 50
DAYS_PER_UNIT = {"d": 1.0, "w": 7.0, "m": 30.0}
RELATIVE_SINCE = r"-(\d+(?:\.\d+)?)([dwm])"


def glob_regex(glob: str) -> str:
    """Java regex for a shell glob: ``*``, ``?``, ``[seq]`` and ``[!seq]``, all else literal."""
    out, rest = "", glob
    while rest:
        token = re.match(r"\*|\?|\[(!?)(\]?[^\]]*)\]|.", rest, re.DOTALL)
        head = token.group(0)
        if head == "*":
            out += ".*"
        elif head == "?":
            out += "."
        elif token.group(2):
            members = re.sub(r"([\\\[\]&^])", r"\\\1", token.group(2))
            out += f"[{'^' if token.group(1) else ''}{members}]"
        else:
            out += f"\\Q{head}\\E"
        rest = rest[token.end() :]
    return f"(?s)^{out}$"


def glob_terms(spec: str) -> tuple[list[str], list[str]]:
    """Included and excluded globs of a comma-separated spec."""
    terms = [t.strip() for t in spec.split(",") if t.strip()]
    if not terms:
        raise ValueError("the filter has no terms")
    sides: dict[bool, list[str]] = {True: [], False: []}
    for term in terms:
        glob = term.lstrip() if term[0] not in "!+" else term[1:].strip()
        if not glob:
            raise ValueError(f"nothing follows the prefix in {term!r}")
        sides[term[0] != "!"].append(glob)
    return sides[True], sides[False]


def glob_filter(df: DataFrame, column: str, spec: str) -> DataFrame:
    """Keep rows matching any included glob and no excluded one, ignoring case.

    A null never matches: an include drops it, an exclude-only spec keeps it.
    """
    included, excluded = glob_terms(spec)

    def matches(globs: list[str]) -> Column:
        one = F.lit(False)
        for glob in globs:
            one = one | F.lower(column).rlike(glob_regex(glob.lower()))
        return F.coalesce(one, F.lit(False))

    kept = df.filter(matches(included)) if included else df
    return kept.filter(~matches(excluded)) if excluded else kept


def meta_filter(
    df: DataFrame,
    min_duration: float = 0.0,
    since: float | dt.datetime | None = None,
    duration: str = "duration",
    date: str = "ts",
) -> DataFrame:
    """Keep rows long and new enough; unknown durations and dates are kept."""
    kept = df.filter(F.col(duration).isNull() | (F.col(duration) >= min_duration))
    if since is None:
        return kept
    return kept.filter(F.col(date).isNull() | (F.col(date) >= F.lit(since)))


def parse_since(spec: str, now: dt.datetime) -> dt.datetime:
    """Instant meant by ``-3d`` / ``-2w`` / ``-1.5m`` before ``now``, or an ISO date (UTC)."""
    text = spec.strip()
    relative = re.fullmatch(RELATIVE_SINCE, text, re.IGNORECASE)
    if relative:
        days = float(relative[1]) * DAYS_PER_UNIT[relative[2].lower()]
        return now - dt.timedelta(days=days)
    try:
        at = dt.datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"cannot read {spec!r} as a date or -Nd/-Nw/-Nm") from None
    return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)


def parse_picks(spec: str) -> list[tuple[int, int]]:
    """Inclusive ranges of a 1-based selection such as ``1,3-5``."""
    ranges = []
    for token in (t.strip() for t in spec.split(",")):
        if not token:
            continue
        bounds = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", token)
        if not bounds:
            raise ValueError(f"cannot read {token!r} as a number or range")
        lo, hi = sorted((int(bounds[1]), int(bounds[2] or bounds[1])))
        if lo < 1:
            raise ValueError("positions start at 1")
        ranges.append((lo, hi))
    if not ranges:
        raise ValueError("the selection is empty")
    return ranges


def select_positions(
    df: DataFrame, spec: str, order: Sequence[Column | str], by: Sequence[str] = (), strict: bool = True
) -> DataFrame:
    """Pick rows of each group by position in ``order``; adds ``pos``.

    A position past the end of a group fails the query; unless ``strict``, such a group
    gives no rows. Only rows up to the highest position leave a partition, so a large group
    costs no more than a small one.
    """
    ranges = parse_picks(spec)
    top = max(hi for _, hi in ranges)
    groups = list(by) or ["__all"]
    grouped = df if by else df.withColumn("__all", F.lit(0))
    w = Window.partitionBy(*groups).orderBy(*order)
    picked = grouped.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= top)
    wanted = F.lit(False)
    for lo, hi in ranges:
        wanted = wanted | F.col("pos").between(lo, hi)
    reached = F.max("pos").over(Window.partitionBy(*groups))
    picked = picked.withColumn("__reached", reached)
    if not strict:
        return picked.filter(F.col("__reached") >= top).filter(wanted).drop("__reached", "__all")
    fits = F.assert_true(
        F.col("__reached") >= top,
        F.concat(F.lit(f"position {top} is outside the table of "), F.col("__reached").cast("string")),
    )
    return picked.filter(fits.isNull()).filter(wanted).drop("__reached", "__all")


def catalog_order(df: DataFrame, key: str, by: Sequence[str], blocks: Blocks) -> tuple[DataFrame, list[Column]]:
    """Order columns of a sort key; dates may need a look at the whole listing first."""
    if key not in SORTS:
        raise ValueError(f"unknown sort {key!r}, expected one of {SORTS}")
    if key == "duration":
        return df, [F.desc_nulls_last("duration"), F.asc("pos")]
    if key == "views":
        return df, [F.desc_nulls_last("view_count"), F.asc("pos")]
    dated = df.groupBy(*by).agg(F.max(F.col("ts").isNotNull()).alias("__dated"))
    number = F.regexp_extract("video_id", r"^v?(\d+)$", 1)
    return spread_join(df, dated, by) if blocks.cols else df.join(dated, list(by)), [
        F.when(F.col("__dated"), F.col("ts")).desc_nulls_last(),
        # Without dates a higher number is newer; ids that are no number come first, as listed.
        F.when(~F.col("__dated") & (number != ""), number.cast("double")).desc_nulls_first(),
        F.asc("pos"),
    ]


def sort_catalog(
    df: DataFrame, key: str, by: Sequence[str] = ("listing",), blocks: Blocks | None = None
) -> DataFrame:
    """Order each listing by ``date``, ``duration`` or ``views``, unknown values last.

    Adds ``rank``, the 1-based place in the listing; equal rows keep their ``pos`` order.
    """
    blocks = blocks or pick_blocks(df, by)
    ready, order = catalog_order(df, key, by, blocks)
    return positions(ready, by, order, blocks, "rank").drop("__dated")


def first_n_per_listing(
    df: DataFrame, n: int = LISTING_WINDOW, by: Sequence[str] = ("listing",), order: str = "pos"
) -> DataFrame:
    """Only the first ``n`` entries of every listing."""
    if n < 1:
        raise ValueError("n must be at least 1")
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def latest_checkpoint(
    df: DataFrame, keys: Sequence[str], mtime: str, priority: str, exists: Column | None = None
) -> DataFrame:
    """One artifact per key: the newest primary (priority 0), else the first fallback there is.

    Of equal ones the smallest row counts, by its columns in their order.
    """
    there = df.filter(exists) if exists is not None else df
    row = F.struct(*[c for c in there.columns if c not in keys])
    first = F.struct(F.col(priority), -F.col(mtime).cast("double"), row)
    return there.groupBy(*keys).agg(F.min_by(row, first).alias("a")).select(*keys, "a.*")


def unfinished(entries: DataFrame, done: DataFrame, url: str = "url") -> DataFrame:
    """Entries whose URL is known and not completed."""
    return entries.filter(F.col(url).isNotNull()).join(done.select(url), url, "left_anti")


def merge_completed(before: DataFrame, now: DataFrame, url: str = "url") -> DataFrame:
    """Distinct completed URLs of earlier runs and this one."""
    return before.select(url).unionByName(now.select(url)).distinct()


def batch_outcome(results: DataFrame, batch: str, status: str) -> DataFrame:
    """Succeeded and failed counts per batch."""
    return results.groupBy(batch).agg(
        F.count_if(F.col(status) == "ok").alias("ok"),
        F.count_if(F.col(status) == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
    )


def failed_entries(results: DataFrame, batch: str, url: str, status: str) -> DataFrame:
    """The failed entries, one row each."""
    return results.filter(F.col(status) == "failed").select(batch, url)


def recent_top_k(df: DataFrame, user: str, item: str, ts: str, k: int = 5) -> DataFrame:
    """The ``k`` most recently used distinct items of every user; adds ``rank``."""
    latest = df.groupBy(user, item).agg(F.max(ts).alias(ts))
    w = Window.partitionBy(user).orderBy(F.desc(ts), F.asc(item))
    return latest.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max(1, k))


def expand_queue(
    queue: DataFrame,
    catalog: DataFrame,
    spec: str,
    sort: str = "date",
    glob: str | None = None,
    min_duration: float = 0.0,
    since: float | dt.datetime | None = None,
) -> DataFrame:
    """Replace listing lines of a queue by their filtered, sorted, picked entries.

    ``queue`` holds ``line_no`` and ``entry``; an entry that names a listing of the
    catalogue is expanded, any other passes through. Result: ``line_no``, ``rank``,
    ``title``, ``url``; ``line_no`` and ``rank`` give the queue's order. A listing without a
    usable pick gives no rows; ``queue_problems`` names it.
    """
    shown = glob_filter(catalog, "title", glob) if glob else catalog
    shown = meta_filter(shown, min_duration, since)
    ready, order = catalog_order(shown, sort, ["listing"], pick_blocks(shown, ["listing"]))
    picks = select_positions(ready, spec, order, ["listing"], strict=False)
    listings = catalog.select(F.col("listing").alias("entry")).distinct()
    expanded = queue.join(
        picks.select(F.col("listing").alias("entry"), F.col("pos").alias("rank"), "title", "url"),
        "entry",
    )
    plain = queue.join(listings, "entry", "left_anti").select(
        "line_no",
        F.lit(1).alias("rank"),
        F.lit(None).cast("string").alias("title"),
        F.col("entry").alias("url"),
    )
    return expanded.select("line_no", "rank", "title", "url").unionByName(plain)


def queue_problems(
    queue: DataFrame,
    catalog: DataFrame,
    spec: str,
    glob: str | None = None,
    min_duration: float = 0.0,
    since: float | dt.datetime | None = None,
) -> DataFrame:
    """Queue lines whose listing cannot be expanded: ``line_no``, ``entry``, ``entries``, ``reason``.

    ``entries`` counts what the filters leave. The reason is ``empty`` when that is nothing,
    and ``short`` when ``spec`` asks for a position past it.
    """
    top = max(hi for _, hi in parse_picks(spec))
    shown = glob_filter(catalog, "title", glob) if glob else catalog
    left = meta_filter(shown, min_duration, since).groupBy("listing").agg(F.count(F.lit(1)).alias("entries"))
    listings = catalog.select("listing").distinct().join(left, "listing", "left")
    short = listings.select(
        F.col("listing").alias("entry"), F.coalesce("entries", F.lit(0)).alias("entries")
    ).filter(F.col("entries") < top)
    reason = F.when(F.col("entries") == 0, "empty").otherwise("short")
    return queue.join(short, "entry").select("line_no", "entry", "entries", reason.alias("reason"))
