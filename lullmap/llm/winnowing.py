"""Document fingerprints by winnowing, in built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullmap.llm.common import query, stored, table, text_of

# Bytes of a k-gram, and k-grams of a window (a power of two).
GRAM = 16
WINDOW = 32
# Windows handled at once inside a text; arrays of this length are made of it.
STEP = 4096
_HIGH = 0x7FFFFFFF00000000
_LOW = 0xFFFFFFFF


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, worked out once however often it names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def window_minima(grams: Column, window: int) -> Column:
    """The least of each ``window`` neighbours, by doubling; places near the end see fewer."""
    assert window & (window - 1) == 0, "the window must be a power of two"

    def doubled(shift: int) -> Callable[[Column], Column]:
        return lambda v: F.zip_with(v, F.slice(v, 1 + shift, F.size(v)), lambda x, y: F.least(x, y))

    shift = 1
    while shift < window:
        grams = let(grams, doubled(shift))
        shift *= 2
    return grams


def fingerprint(data: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Selected k-grams of a binary column, as longs in order of place.

    Every place of the text starts a k-gram of ``gram`` bytes with a hash of 31 bits, and of
    every ``window`` neighbouring k-grams the one of least hash is selected, the rightmost of
    equal ones. So a passage of ``gram + window - 1`` bytes that two texts share has a selected
    k-gram in common, and none shorter than ``gram`` bytes counts. A long holds the hash in its
    upper half less the place, from 1, which lets the rightmost win; ``hash_of`` and
    ``place_of`` take it apart.

    A text shorter than a k-gram is one k-gram, one of fewer k-grams than a window is one
    window, an empty one selects none; null gives null. Texts are worked through in steps of
    ``STEP`` windows, so no array is longer than that but the selection itself.
    """

    def whole(b: Column) -> Column:
        windows = F.greatest(F.length(b) - (gram + window - 2), F.lit(1))

        def one(step: Column) -> Column:
            first = step * STEP

            def keys(piece: Column) -> Column:
                at = F.sequence(F.lit(1), F.greatest(F.length(piece) - (gram - 1), F.lit(1)))
                high = lambda i: F.xxhash64(F.substring(piece, i, F.lit(gram))).bitwiseAND(F.lit(_HIGH))
                return F.transform(at, lambda i: high(i) - i)

            piece = F.substring(b, first + 1, F.lit(STEP + window + gram - 2))
            least = window_minima(let(piece, keys), window)
            chosen = F.array_distinct(F.slice(least, F.lit(1), F.least(F.lit(STEP), windows - first)))
            return let(first.cast("long"), lambda f: F.transform(chosen, lambda k: k - f))

        steps = F.sequence(F.lit(0), F.call_function("div", windows - 1, F.lit(STEP)).cast("int"))
        return F.array_distinct(F.flatten(F.transform(steps, one)))

    none = F.array().cast("array<long>")
    return F.when(F.length(data) == 0, none).when(data.isNotNull(), let(data, whole))


def after_edit(old: Column, data: Column, unchanged: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Fingerprint of ``data``, of which the first ``unchanged`` bytes are those of a text with fingerprint ``old``.

    Windows inside the unchanged bytes select what they did; only the others, and the last
    few before them, are taken anew. The result is that of ``fingerprint(data)``.
    """
    last = unchanged - (gram + window - 1)
    first = F.greatest(last - (window - 1), F.lit(0))
    kept = let(last, lambda p: F.filter(old, lambda k: place_of(k) <= p + 1))
    rest = fingerprint(F.substring(data, first + 1, F.length(data)), gram, window)
    moved = let(first.cast("long"), lambda f: F.transform(rest, lambda k: k - f))
    return F.array_distinct(F.concat(kept, moved))


def place_of(key: Column) -> Column:
    """Byte at which a selected k-gram starts, from 1."""
    return (-key).bitwiseAND(F.lit(_LOW))


def hash_of(key: Column) -> Column:
    return F.shiftright(key + place_of(key), 32).cast("int")


def packed(keys: Column, data: Column) -> Column:
    """A fingerprint of ``data`` in six bytes a k-gram instead of eight, to be moved; long texts take eight."""
    far = F.length(data) > 0xFFFF
    places = F.transform(keys, place_of)
    return F.struct(
        F.transform(keys, hash_of).alias("hashes"),
        F.when(~far, F.transform(places, lambda p: (p - 0x8000).cast("smallint"))).alias("near"),
        F.when(far, F.transform(places, lambda p: p.cast("int"))).alias("far"),
    )


def unpacked(moved: Column) -> Column:
    near = F.transform(moved["near"], lambda p: p.cast("int") + 0x8000)
    return F.zip_with(moved["hashes"], F.coalesce(near, moved["far"]), lambda h, p: F.shiftleft(h.cast("long"), 32) - p)


def hashes(keys: Column) -> Column:
    """The different hashes of a fingerprint."""
    return F.array_distinct(F.transform(keys, hash_of))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either side that both hold; 1 for two empty sides."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def told(keys: Column) -> Column:
    """A fingerprint as text: hash:place of each selected k-gram, hash in hex, place from 0."""
    one = lambda k: F.concat(F.lower(F.hex(hash_of(k))), F.lit(":"), (place_of(k) - 1).cast("string"))
    return F.array_join(F.transform(keys, one), " ")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, fingerprint (selected k-grams) and its text form for every row; null text counts as empty."""
    keys = fingerprint(text_of(F.col("text")).cast("binary"), gram, window)
    return docs.select("doc_id", keys.alias("keys")).withColumn("fingerprint", told(F.col("keys")))


def ring(rows: DataFrame, order: str, key: str, extra: str) -> DataFrame:
    """Each key with the key and ``extra`` of the row before it by (``order``, ``key``); the first follows the last.

    Rows are cut into sorted pieces and only one row a piece is brought together.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(pieces, F.asc_nulls_first(order), F.asc(key))
    cut = stored(cut.withColumn("piece", F.spark_partition_id()), "ring")
    own = F.struct(order, key, extra)
    ends = cut.groupBy("piece").agg(F.max(own).alias("end"))
    along = Window.orderBy("piece")
    all_of = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    brought = F.coalesce(F.lag("end").over(along), F.last("end").over(all_of))
    ends = ends.select("piece", brought.alias("end"))
    inside = F.lag(own).over(Window.partitionBy("piece").orderBy(F.asc_nulls_first(order), F.asc(key)))
    before = cut.withColumn("inside", inside).join(F.broadcast(ends), "piece").withColumn("b", F.coalesce("inside", "end"))
    return before.select(key, F.col(f"b.{key}").alias("before_key"), F.col(f"b.{extra}").alias(f"before_{extra}"))


def edit_trail(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike it is to that and to the next text.

    The edited text has its last quarter of code points, rounded down, replaced by as many of
    the next document's first ones. Documents follow doc_id, a null id before all, rows of one
    id by the MD5 of id and text; the last is followed by the first. Rows equal in id and text
    count as one document there, and each gives a row. Null texts count as empty; other
    columns are ignored.

    Texts are moved once, by key: each sends its start and its hashes to the document before.
    """
    text = text_of(F.col("text"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), text)
    base = docs.select("doc_id", text.alias("text")).withColumn("key", F.unhex(F.md5(named)))
    known = base.groupBy("key", "doc_id").agg(F.max(F.length("text")).alias("n"))
    places = ring(known, "doc_id", "key", "n")
    data = F.col("text").cast("binary")
    base = base.withColumn("keys", fingerprint(data, gram, window)).withColumn("moved", packed(F.col("keys"), data)).drop("keys")
    quarter = F.call_function("div", F.col("before_n"), F.lit(4)).cast("int")
    sent = base.join(places, "key").select(
        F.col("before_key").alias("key"),
        F.substring("text", F.lit(1), quarter).alias("start"),
        # All of ``moved`` and of ``base`` is read here, as below, so that both read one exchange.
        hashes(unpacked(F.col("moved"))).alias("next_hashes"),
        F.col("doc_id").alias("next_id"),
    )
    first = [F.first(c).alias(c) for c in ("start", "next_hashes", "next_id")]
    both = base.join(sent.groupBy("key").agg(*first), "key").withColumn("n_chars", F.length("text"))
    kept = F.substring("text", F.lit(1), F.col("n_chars") - F.call_function("div", "n_chars", F.lit(4)).cast("int"))
    both = both.withColumn("keys", unpacked(F.col("moved")))
    both = both.withColumns({"kept": F.octet_length(kept), "edited": F.concat(kept, "start")})
    both = both.withColumn("edited_keys", after_edit(F.col("keys"), F.col("edited").cast("binary"), F.col("kept"), gram, window))
    own = F.col("own")
    return both.withColumn("own", hashes(F.col("keys"))).select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        told(F.col("keys")).alias("fingerprint"),
        told(F.col("edited_keys")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_keys"))).alias("near_edited"),
        likeness(own, F.col("next_hashes")).alias("near_next"),
        "next_id",
    )


@query("op11_winnowing")
def op11_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    return edit_trail(table(spark, sf, "documents"))
