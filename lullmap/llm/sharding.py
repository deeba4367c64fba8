"""Sharding by extendible hashing, in built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lullmap.llm.common import query, stored, table, text_of

SHARD_BYTES = 16 << 20
HASH_BITS = 60
# A cell of the directory is this many bits finer than shards of an even hash would need.
SLACK_BITS = 4


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, size in bytes and the first 60 bits of the MD5 of the id's text."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        F.octet_length(text_of(F.col("text"))).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def prefix(column: str, bits: int, of: int = HASH_BITS):
    return F.shiftright(F.col(column), of - bits)


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Shards of hashed rows, as (bits, table of cell, depth, prefix, shard_bytes, shard_rows).

    All rows start in one bucket. In every round the buckets within the limit become shards
    and the others split on one more bit; a round reads only the cells of buckets that are
    still too large. Cells are aggregated once; where a bucket of one cell is too large, its
    rows are aggregated again into finer cells.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, (total // limit).bit_length() + SLACK_BITS))
    out, depth, pending, left = [], 0, None, rows
    while True:
        pending = stored(
            left.groupBy(prefix("h", bits).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n")), "cells"
        )
        done = []
        while depth <= bits:
            at = prefix("cell", depth, bits).alias("prefix")
            sums = pending.groupBy(at).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            last = depth == HASH_BITS
            cells = pending.withColumn("prefix", prefix("cell", depth, bits)).join(sums, "prefix")
            cells = stored(cells.withColumn("fits", (F.col("shard_bytes") <= limit) | F.lit(last)), "round")
            done.append(cells.filter("fits").select("cell", F.lit(depth).alias("depth"), "prefix", "shard_bytes", "shard_rows"))
            pending = cells.filter(~F.col("fits")).select("cell", "b", "n")
            depth += 1
            if pending.isEmpty():
                pending = None
                break
        out.append((bits, reduce(DataFrame.unionByName, done)))
        if pending is None:
            return out
        left = left.join(pending.select(F.col("cell").alias("c")), prefix("h", bits) == F.col("c"), "left_semi")
        bits = min(HASH_BITS, bits + 8)


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The shard of every document: doc_id, n_bytes, shard (its hash prefix), depth, page,
    shard_bytes and shard_rows; shards hold at most ``limit`` bytes of text.

    Documents go by the hash of their id, so a shard's place needs nothing but the directory.
    Rows of one id share all bits: if they exceed the limit together they are told apart by
    ``page``, filled by size; so is a document that is larger than a shard, which has a page
    of its own. Null text has no bytes; a null id counts as an empty one. Empty tables give no
    shards. Other columns are ignored.
    """
    rows = stored(hashed(docs).withColumn("part", F.spark_partition_id()), "hashed")
    parts = [
        rows.join(cells, prefix("h", bits) == F.col("cell")).withColumn("shard", _bits(F.col("prefix"), F.col("depth")))
        for bits, cells in directory(rows, limit)
    ]
    found = reduce(DataFrame.unionByName, parts)
    large = F.col("shard_bytes") > limit
    columns = ["doc_id", "n_bytes", "shard", "depth", "page", "shard_bytes", "shard_rows"]
    out = found.filter(~large).withColumn("page", F.lit(0).cast("long")).select(columns)
    if rows.groupBy("h").agg(F.sum("n_bytes").alias("b")).filter(F.col("b") > limit).isEmpty():
        return out
    # Only rows that no bit tells apart are put in order, those of each stored part by themselves.
    # Half a limit of them begins on a page, so that they fit it; larger rows have their own.
    w = Window.partitionBy("shard", "part").orderBy("n_bytes")
    before = F.coalesce(F.sum("n_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    half = limit / 2
    page = F.when(F.col("n_bytes") > half, F.row_number().over(w) + (1 << 31)).otherwise(F.floor(before / half))
    paged = found.filter(large).withColumn("page", (F.col("part").cast("long") * (1 << 32) + page).cast("long"))
    sums = paged.groupBy("shard", "page").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_rows"))
    return out.unionByName(paged.drop("shard_bytes", "shard_rows").join(sums, ["shard", "page"]).select(columns))


def _bits(value, depth):
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(value), depth, "0"))


@query(
    "op4_extendible_shards",
    f"""
    WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes,
      list_reduce(list_transform(string_split(substr(md5(CAST(doc_id AS VARCHAR)), 1, 6), ''),
        lambda c: right('000' || bin(position(c IN '0123456789abcdef') - 1), 4)), lambda a, b: a || b) AS h FROM documents),
    p AS (SELECT d.*, depth, left(h, CAST(depth AS INT)) AS shard, sum(n_bytes) OVER (PARTITION BY depth, left(h, CAST(depth AS INT))) AS shard_bytes,
      count(*) OVER (PARTITION BY depth, left(h, CAST(depth AS INT))) AS shard_rows FROM d, range(0, 25) AS r(depth)),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k FROM p WHERE shard_bytes <= {SHARD_BYTES})
    SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows
    FROM q WHERE k = 1
    """,
)
def op4_extendible_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard(table(spark, sf, "documents"))
