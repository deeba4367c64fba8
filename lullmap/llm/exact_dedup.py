"""Exact deduplication with the heavy hitters split off: they never meet in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import free_name, query, stored, table, text_of

# Counters of a summary; a digest on more than 2 / COUNTERS of all rows is always found.
COUNTERS = 1024


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its id and the SHA-256 of its text, null counting as empty."""
    return docs.select("doc_id", F.sha2(text_of(F.col("text")), 256).alias("text_sha256"))


def summaries(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries summary of every partition: at most ``counters`` digests with a lower count."""

    def shrink(values: np.ndarray, counts: np.ndarray):
        if len(values) > counters:
            counts = counts - np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1]
            values, counts = values[counts > 0], counts[counts > 0]
        return values, counts

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.empty(0, "S64"), np.empty(0, np.int64)
        for batch in batches:
            own = np.array(batch.column(0).to_pylist(), "S64")
            both = np.concatenate([values, own])
            weights = np.concatenate([counts, np.ones(len(own), np.int64)])
            values, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, weights, len(values)).astype(np.int64)
            values, counts = shrink(values, counts)
        if len(values):
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(str)), pa.array(counts)], ["text_sha256", "n"])

    return rows.select("text_sha256").mapInArrow(summarise, "text_sha256 string, n long")


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Frequent digests with their true count and largest id; at most ``counters`` rows.

    A partition's counter falls short by at most its rows / counters, so the sum of a digest's
    counters falls short by at most all rows / counters: one with over twice that many rows is
    among the ``counters`` largest sums. The counts are then verified over all rows.
    """
    likely = (
        summaries(rows, counters)
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "text_sha256")
        .limit(counters)
        .select("text_sha256")
    )
    return (
        rows.join(F.broadcast(likely), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Groups of equal texts; of each, the largest ``doc_id`` stays.

    Returns a row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Rows of
    frequent digests are marked where they lie, from a broadcast of at most ``counters`` rows;
    the others are counted and joined by digest.

    Null text counts as empty. A null id counts as smaller than any other; keep_id is null only
    in groups of null ids. Rows that repeat id and text are all counted, and carry equal marks.
    """
    rows = stored(digests(docs), "digests")
    winners = stored(heavy_hitters(rows, counters), "winners")
    frequent = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return frequent.select(columns).unionByName(rest.join(groups, "text_sha256").select(columns))


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of every text, that of the largest id; all columns stay.

    Of rows that repeat id and text, any one stays.
    """
    marks = stored(exact_dedup(docs, counters), "marks")
    key, digest, other = (free_name(docs, c) for c in ("kept_id", "own_sha256", "kept_sha256"))
    kept = marks.filter("kept").groupBy(F.col("doc_id").alias(key), F.col("text_sha256").alias(other)).count()
    kept = stored(kept, "kept")
    out = docs.withColumn(digest, F.sha2(text_of(F.col("text")), 256)).join(
        kept.select(key, other).hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(digest) == F.col(other)),
        "left_semi",
    )
    if not kept.filter(F.col("count") > 1).isEmpty():
        out = out.dropDuplicates(["doc_id", digest])
    return out.select(docs.columns)


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
    """,
)
def op8_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents"))
