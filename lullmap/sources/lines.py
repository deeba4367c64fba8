"""Line formats: listings, queues, transfer progress, detector logs, JSON logs.

Each format has a parser over a DataFrame of lines, and a reader over files. Line order
only matters to the queue and the detector log; their readers number the lines of a file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullmap.functions.urls import entry_url
from lullmap.operators.intervals import END, START
from lullmap.plans.blocks import Blocks, carry, ordered, pick_blocks, positions

# Fixed values of the formats.
LISTING_SEPARATOR, LISTING_FIELDS = "::", 5
PROGRESS_PREFIX, PROGRESS_FIELDS = "progress|", 5
TAG_END = "\t"
NUMBER = r"(-?\d+(?:[.,]\d+)?)"
QUIET_START, QUIET_END = rf"silence_start:\s*{NUMBER}", rf"silence_end:\s*{NUMBER}"
LOG_VERSION = 1
LOG_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("v", T.IntegerType()),
        T.StructField("exc", T.StringType()),
        T.StructField("step", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
    ]
)


def finite(text: Column) -> Column:
    """A number that is neither NaN nor infinite, else null."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def parse_listing(
    lines: DataFrame, line: str = "value", platform: str = "youtube", carry_over: Sequence[str] = ()
) -> DataFrame:
    """Catalogue rows of ``id::duration::views::timestamp::title`` lines.

    Malformed lines and blank ids are skipped, unreadable numbers become null, and a
    title may hold the separator. ``carry_over`` columns are kept.
    """
    f = F.split(line, LISTING_SEPARATOR, LISTING_FIELDS)
    whole = lambda c: finite(c).cast("long")
    return (
        lines.withColumn("__f", f)
        .filter((F.size("__f") == LISTING_FIELDS) & (F.col("__f")[0] != ""))
        .select(
            *carry_over,
            F.col("__f")[0].alias("video_id"),
            entry_url(F.col("__f")[0], F.lit(platform)).alias("url"),
            F.nullif(F.col("__f")[4], F.lit("")).alias("title"),
            finite(F.col("__f")[1]).alias("duration"),
            whole(F.col("__f")[2]).alias("view_count"),
            whole(F.col("__f")[3]).alias("ts"),
        )
    )


def file_lines(spark: SparkSession, path: str, tagged: bool = False) -> DataFrame:
    """``source``, ``line`` and two columns that order the lines of a file.

    A large file is read in splits by several tasks: a line's place is its split's offset
    and, within the split, the order in which it was read. The source is the file, or in
    ``tagged`` files what ``write_tagged_lines`` put before each line; lines without are left out.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("split_line"),
        F.col("value").alias("line"),
    )
    if not tagged:
        return lines
    end = F.instr("line", TAG_END)
    tag = F.url_decode(F.substring_index("line", TAG_END, 1))
    return lines.filter(end > 0).withColumns({"source": tag, "line": F.col("line").substr(end + 1, F.length("line"))})


def write_tagged_lines(df: DataFrame, source: str, order: Sequence[str], line: str, path: str) -> None:
    """Lines as text files that hold many sources each, so that files follow the size and not the sources.

    Every line is led by its source, URL-encoded, and a tab; the lines of a source stand in one file, by ``order``.
    """
    tag = F.url_encode(F.col(source).cast("string"))
    placed = df.repartition(source).sortWithinPartitions(source, *order)
    placed.select(F.concat(tag, F.lit(TAG_END), line).alias("value")).write.text(path)


LINE_ORDER = ["split_start", "split_line"]


def numbered_lines(spark: SparkSession, path: str, blocks: Blocks | None = None) -> DataFrame:
    """``source``, ``line_no`` (from 1) and ``line`` of text files."""
    lines = file_lines(spark, path)
    blocks = blocks or pick_blocks(lines, ["source"])
    return positions(lines, ["source"], LINE_ORDER, blocks, "line_no").drop(*LINE_ORDER)


def parse_queue(lines: DataFrame, line: str = "line") -> DataFrame:
    """Queue entries: trimmed lines that are neither blank nor ``#`` comments."""
    entry = F.trim(line)
    return lines.withColumn("entry", entry).filter((entry != "") & ~entry.startswith("#")).drop(line)


def parse_progress(
    lines: DataFrame,
    line: str = "value",
    carry_over: Sequence[str] = (),
    prefix: str = PROGRESS_PREFIX,
) -> DataFrame:
    """Transfer progress from prefixed five-field lines; other lines are ignored.

    Unknown fields become null; an exact total wins over an estimate.
    """
    body = F.substring(line, len(prefix) + 1, 1 << 30)
    fields = lines.filter(F.col(line).startswith(prefix)).withColumn("__f", F.split(body, r"\|"))
    at = lambda i: finite(F.col("__f")[i])
    return fields.filter(F.size("__f") == PROGRESS_FIELDS).select(
        *carry_over,
        at(0).alias("downloaded_bytes"),
        F.coalesce(at(1), at(2)).alias("total_bytes"),
        at(3).alias("speed"),
        at(4).alias("eta"),
    )


def _micros(text: Column) -> Column:
    exact = F.translate(text, ",", ".").try_cast("decimal(20,6)")
    return (exact * 1_000_000).cast("long")


def parse_quiet_log(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    line: str,
    ends: DataFrame | None = None,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Intervals from ``silence_start:`` / ``silence_end:`` lines of a detector's log.

    A later start replaces an unfinished one, an end without a start is ignored, and a
    line holding both counts as a start. A start left open is closed at the series end
    from ``ends``, or dropped.
    """
    text = F.col(line)
    is_start = text.rlike(QUIET_START)
    marks = lines.filter(is_start | text.rlike(QUIET_END)).select(
        *keys,
        *order,
        is_start.alias("__start"),
        _micros(
            F.when(is_start, F.regexp_extract(line, QUIET_START, 1)).otherwise(
                F.regexp_extract(line, QUIET_END, 1)
            )
        ).alias("__at"),
    )
    blocks = blocks or pick_blocks(marks, keys)
    this = F.struct("__start", "__at")
    cut = blocks.assign(marks.withColumn("__this", this), keys, order)
    cut = carry(
        cut,
        keys,
        blocks,
        {"last": F.max_by("__this", F.struct(*order)), "n": F.count(F.lit(1))},
        {"__prev_in": ("lag", "last"), "__more": ("lead", "n")},
    )
    w = ordered(keys, blocks, order)
    prev_in = F.col("__prev_in").cast("struct<__start: boolean, __at: bigint>")
    cut = cut.withColumns(
        {
            "__prev": F.coalesce(F.lag("__this").over(w), prev_in),
            "__last": F.lead(F.lit(1)).over(w).isNull() & F.col("__more").isNull(),
        }
    )
    paired = ~F.col("__start") & F.coalesce(F.col("__prev.__start"), F.lit(False))
    closed = cut.filter(paired).select(
        *keys, F.col("__prev.__at").alias(START), F.col("__at").alias(END)
    )
    if ends is None:
        return closed
    trailing = (
        cut.filter(F.col("__start") & F.col("__last"))
        .join(ends.select(*keys, END), list(keys))
        .filter((F.col(END) > 0) & (F.col("__at") < F.col(END)))
        .select(*keys, F.col("__at").alias(START), END)
    )
    return closed.unionByName(trailing)


def read_listing(spark: SparkSession, path: str, platform: str = "youtube") -> DataFrame:
    """Catalogue from listing files, one listing per file; ``pos`` follows the lines."""
    lines = numbered_lines(spark, path).withColumnsRenamed({"source": "listing", "line_no": "pos"})
    return parse_listing(lines, "line", platform, ["listing", "pos"])


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Queue entries of text files with their line numbers."""
    return parse_queue(numbered_lines(spark, path))


def read_progress(
    spark: SparkSession, path: str, prefix: str = PROGRESS_PREFIX, tagged: bool = False
) -> DataFrame:
    """Transfer progress of log files, with the columns that order the lines of a file."""
    return parse_progress(file_lines(spark, path, tagged), "line", ["source", *LINE_ORDER], prefix)


def read_quiet_log(
    spark: SparkSession, path: str, ends: DataFrame | None = None, tagged: bool = False
) -> DataFrame:
    """Intervals of detector logs, keyed by ``source``: the file, or the tag of the lines."""
    return parse_quiet_log(file_lines(spark, path, tagged), ["source"], LINE_ORDER, "line", ends)


def read_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log records of JSON-lines files; an unreadable line is kept as ``_corrupt_record``."""
    schema = T.StructType([*LOG_SCHEMA, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_json_logs(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Log records as JSON lines, optional fields left out where null."""
    given = [f.name for f in LOG_SCHEMA if f.name in df.columns]
    stamped = df.select(*given).withColumn("v", F.lit(LOG_VERSION))
    stamped.write.mode(mode).option("ignoreNullFields", True).json(path)
