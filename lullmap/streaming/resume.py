"""Going on where a stopped detection was: its state as a table, the interval cache, a new stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.plans.scratch import pinned
from lullmap.sources.stores import cached_sources, write_interval_cache


def open_runs(spark: SparkSession, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """What a stopped ``stream_quiet`` knows of each series, read from its checkpoint.

    keys, ``start_us`` of a run that is still open (null if none), ``last_us``, the time up to
    which rows were used, and ``end_us``, the known end of the series. The state is that of
    the last committed micro-batch; the query need not be started again.
    """
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return state.select(*[F.col(f"key.{k}").alias(k) for k in keys], "value.start_us", "value.last_us", "value.end_us")


def store_probes(
    intervals: DataFrame, runs: DataFrame, path: str, config: dict[str, float], source: Column
) -> None:
    """Write what a stopped query emitted and how far it got to the interval cache.

    ``intervals`` are its closed intervals (keys, ``start_us``, ``end_us``), ``runs`` its
    ``open_runs``; ``source`` names a series from its keys. Every series gets a head with
    ``probe_us`` and ``begun_us``, also one without an interval so far.
    """
    size = F.lit(None).cast("long").alias("source_size")
    heads = runs.select(source.alias("source"), size, F.col("last_us").alias("probe_us"), F.col("start_us").alias("begun_us"))
    write_interval_cache(intervals.select(source.alias("source"), size, "start_us", "end_us"), path, config, heads)


def stored_runs(
    spark: SparkSession, path: str, requests: DataFrame, config: dict[str, float], keys: Mapping[str, Column]
) -> DataFrame:
    """The ``initial_state`` of ``stream_quiet`` for the ``requests`` that hit the cache.

    ``keys`` gives the key columns from ``source``. A source that misses, is older than its
    rows or was never probed is not in it, and is so detected from its start.
    """
    heads = cached_sources(spark, path, requests, config).filter(F.col("probe_us").isNotNull())
    return pinned(
        heads.select(
            *[c.alias(k) for k, c in keys.items()],
            F.col("begun_us").alias("start_us"),
            F.col("probe_us").alias("last_us"),
            F.lit(None).cast("long").alias("end_us"),
        )
    )


def after_probe(sdf: DataFrame, runs: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows of a stream that ``runs`` did not see yet; rows at the very time of a probe count as seen."""
    known = runs.select(*keys, F.col("last_us").alias("__probe"))
    rows = sdf.join(known, list(keys), "left")
    return rows.filter(F.col("__probe").isNull() | (F.unix_micros(ts) > F.col("__probe"))).drop("__probe")
