"""Stores that make work resumable: cached intervals and batch state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lullmap.operators.quality import CONFIG_FIELDS, cache_hits

BATCH_VERSION = 1
BATCH_SCHEMA = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [T.StructField("title", T.StringType()), T.StructField("url", T.StringType())]
                )
            ),
        ),
        T.StructField("completed_urls", T.ArrayType(T.StringType())),
        T.StructField("dry_run", T.BooleanType()),
    ]
)
CACHE_SCHEMA = (
    "source string, source_size long, probe_us long, begun_us long, start_us long, end_us long, "
    + ", ".join(f"{c} double" for c in CONFIG_FIELDS)
    + ", cached_at timestamp, written string, config_hash string"
)
STATE_SCHEMA = "kind string, batch string, pos int, title string, url string, version int, dry_run boolean, saved_at long"


def config_hash(threshold: float, min_silence: float, margin: float) -> str:
    """Partition name of a parameter set; equal numbers give equal names."""
    import hashlib

    text = "|".join(repr(float(v)) for v in (threshold, min_silence, margin))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def write_interval_cache(
    intervals: DataFrame, path: str, config: dict[str, float], sources: DataFrame | None = None
) -> None:
    """Add detected intervals (``source``, ``source_size``, ``start_us``, ``end_us``) under a config.

    ``sources`` (``source``, ``source_size`` and optionally ``probe_us``, how far detection
    got, and ``begun_us``, the start of a run still open there) lists what was looked at, so
    that a source without a quiet moment is known too; left out, it is the sources of the
    intervals. Each source of a call gets a head row and its intervals; of several calls the
    newest counts, and what other calls stored stays, see ``compact_interval_cache``.
    """
    fields = ["source", "source_size", "probe_us", "begun_us"]
    heads = intervals if sources is None else sources
    unknown = [c for c in fields[2:] if c not in heads.columns]
    heads = heads.withColumns({c: F.lit(None).cast("long") for c in unknown})
    heads = heads.groupBy(*fields[:2]).agg(F.max(F.struct(*fields[2:])).alias("h")).select(*fields[:2], "h.*")
    rows = heads.select(*fields, *[F.lit(None).cast("long").alias(c) for c in ("start_us", "end_us")]).unionByName(
        intervals.select("source", "source_size", "start_us", "end_us"), allowMissingColumns=True
    )
    stamped = rows.withColumns(
        {
            **{c: F.lit(float(config[c])) for c in CONFIG_FIELDS},
            "cached_at": F.current_timestamp(),
            "written": F.lit(uuid.uuid4().hex),
            "config_hash": F.lit(config_hash(*(config[c] for c in CONFIG_FIELDS))),
        }
    )
    stamped.write.mode("append").partitionBy("config_hash").parquet(path)


def compact_interval_cache(spark: SparkSession, path: str, to: str) -> None:
    """Write to ``to`` the newest write of every source and config in ``path``, and nothing else."""
    stored = _stored(spark, path)
    heads = stored.filter(F.col("start_us").isNull())
    newest = heads.groupBy("config_hash", "source").agg(F.max(F.struct("cached_at", "written")).alias("h"))
    newest = newest.select("config_hash", "source", "h.written")
    stored.join(newest, ["config_hash", "source", "written"], "left_semi").write.partitionBy("config_hash").parquet(to)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def cached_sources(
    spark: SparkSession, path: str, requests: DataFrame, config: dict[str, float]
) -> DataFrame:
    """Heads of the ``requests`` (``source``, ``source_size``, ``source_mtime``) that hit.

    ``source``, ``source_size``, ``probe_us``, ``begun_us``, ``cached_at`` and ``written``. The config
    selects one partition, so other parameter sets are not read. Only the newest write of a
    source can be hit: it replaces older ones, whatever size they had.
    """
    wanted = config_hash(*(config[c] for c in CONFIG_FIELDS))
    stored = _stored(spark, path).filter((F.col("config_hash") == wanted) & F.col("start_us").isNull())
    head = F.struct("cached_at", "written", "source_size", "probe_us", "begun_us", *CONFIG_FIELDS)
    newest = stored.groupBy("source").agg(F.max(head).alias("h")).select("source", "h.*")
    asked = requests.withColumns({c: F.lit(float(config[c])) for c in CONFIG_FIELDS})
    hits = cache_hits(asked, newest).select("source").distinct()
    return newest.join(hits, "source", "left_semi").drop(*CONFIG_FIELDS)


def read_interval_cache(
    spark: SparkSession, path: str, requests: DataFrame, config: dict[str, float]
) -> DataFrame:
    """Cached intervals of the ``requests`` that hit, as ``cached_sources`` tells them."""
    wanted = config_hash(*(config[c] for c in CONFIG_FIELDS))
    stored = _stored(spark, path).filter((F.col("config_hash") == wanted) & F.col("start_us").isNotNull())
    hits = cached_sources(spark, path, requests, config)
    return stored.select("source", "written", "start_us", "end_us").join(hits, ["source", "written"])


def read_batch_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (``batch``, ``pos``, ``title``, ``url``) and completed URLs of batch documents.

    A document is one JSON object per file; ``batch`` is the file.
    """
    state = spark.read.schema(BATCH_SCHEMA).option("multiLine", True).json(path)
    named = state.withColumn("batch", F.col("_metadata.file_path"))
    entries = named.select("batch", F.posexplode("entries").alias("pos", "e")).select(
        "batch", "pos", "e.title", "e.url"
    )
    done = named.select("batch", F.explode("completed_urls").alias("url"))
    return entries, done


def write_batch_state(
    entries: DataFrame, completed: DataFrame, path: str, dry_run: bool = False, merge: bool = False
) -> None:
    """Batch state as JSON lines, one per entry and per completed URL.

    Unlike a single document this has no size limit: no batch passes through one task.
    ``entries`` holds ``batch``, ``pos``, ``title``, ``url``; ``completed`` the batch and URL.
    With ``merge`` the rows join what is stored; readers keep the newest entries of a batch
    and the completed URLs of all writes.
    """
    rows = entries.select(F.lit("entry").alias("kind"), "batch", "pos", "title", "url").unionByName(
        completed.select(F.lit("completed").alias("kind"), "batch", "url").distinct(),
        allowMissingColumns=True,
    )
    stamp = {"version": F.lit(BATCH_VERSION), "dry_run": F.lit(dry_run), "saved_at": F.unix_micros(F.current_timestamp())}
    rows.withColumns(stamp).write.mode("append" if merge else "overwrite").json(path)


def read_batch_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries, of the newest write of each batch that has any, and all completed URLs."""
    rows = spark.read.schema(STATE_SCHEMA).json(path)
    entries = rows.filter(F.col("kind") == "entry")
    newest = entries.groupBy("batch").agg(F.max("saved_at").alias("saved_at"))
    entries = entries.join(newest, ["batch", "saved_at"], "left_semi").select("batch", "pos", "title", "url")
    return entries, rows.filter(F.col("kind") == "completed").select("batch", "url").distinct()
