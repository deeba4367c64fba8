"""Benchmark decontamination by spaced seeds: hits that forgive substituted words, then verified."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import NARROW_BYTES, mixed, query, slices, table, text_arrays, text_of, words

# Positions of a window of words that count (1) and that are ignored (0). Wherever a quarter of 12
# to 23 words is substituted one of them hits, and a longer overlap holds one of 12 to 23 words.
MASKS = (
    "111111", "1110111", "1101111", "1111011", "11011011", "101110011",
    "1110001011", "1101010011", "11001001011", "110000101011", "11110101",
)
# What items of so many words need besides, to be hit wherever a quarter of them is substituted.
SHORT_MASKS = {
    5: ("1111", "11101", "11011", "10111"),
    6: ("11111", "111101", "111011", "110111", "101111"),
    7: ("1111101", "1011111"),
    8: ("11111", "11100011", "11001101", "101111", "10110011", "1101011"),
    9: ("11000111", "1011101"),
}
# Items are sought down to this many words.
LEAST_WORDS = 5
# An overlap has so many words, or all of a shorter item, and this share of them equal.
OVERLAP_WORDS, SIMILARITY = 12, 0.75
# Bytes of benchmark text whose index a task holds; a larger benchmark is searched in blocks.
INDEX_BYTES = 8 << 20

# A word is a run of letters, digits and bytes over 127.
_APART = np.array([not (chr(b).isalnum() or b > 127) for b in range(256)])
_MULTIPLIERS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_TABLE_BITS = 22


def _offsets(mask: str) -> np.ndarray:
    return np.flatnonzero([c == "1" for c in mask])


def _seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the counted words of the window at every position where one fits."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, np.uint64(salt + 1))
    for j, o in enumerate(_offsets(mask)):
        out += h[o : o + n] * _MULTIPLIERS[j]
    return mixed(out)


@dataclass
class Index:
    """Seeds of benchmark items, sorted by hash, with a bit table that settles most look-ups."""

    item_ids: list
    words: list[np.ndarray]
    masks: list[str]
    hashes: np.ndarray
    items: np.ndarray
    places: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(item_ids: list, texts: list[str]) -> Index:
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        own = [words(d, np.array([0, len(d)]), _APART)[2] if len(d) else np.empty(0, np.uint64) for d in data]
        lengths = {len(w) for w in own}
        short = [(m, k) for k, more in SHORT_MASKS.items() if k in lengths for m in more]
        hashes, items, places = [], [], []
        for salt, (mask, length) in enumerate([*((m, None) for m in MASKS), *short]):
            for i, w in enumerate(own):
                if len(w) < LEAST_WORDS or length not in (None, len(w)):
                    continue
                s = _seeds(w, mask, salt)
                hashes.append(s)
                items.append(np.full(len(s), i, np.int32))
                places.append(np.arange(len(s), dtype=np.int32))
        masks = [*MASKS, *(m for m, _ in short)]
        join = lambda x, t: np.concatenate(x).astype(t, copy=False) if x else np.empty(0, t)
        hashes, items, places = join(hashes, np.uint64), join(items, np.int32), join(places, np.int32)
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << _TABLE_BITS, bool)
        bits[hashes >> np.uint64(64 - _TABLE_BITS)] = True
        return Index(item_ids, own, masks, hashes[order], items[order], places[order], bits)

    def overlaps(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """Verified overlaps of texts: text, item, start in either, words, equal words.

        ``h`` are the word hashes of concatenated texts, ``first`` where each text begins.
        """
        doc_ids, item_ids, shifts = [], [], []
        for salt, mask in enumerate(self.masks):
            s = _seeds(h, mask, salt)
            at = np.flatnonzero(self.table[s >> np.uint64(64 - _TABLE_BITS)])
            s = s[at]
            low, high = np.searchsorted(self.hashes, s, "left"), np.searchsorted(self.hashes, s, "right")
            some = high > low
            at, low, high = at[some], low[some], high[some]
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + len(mask) <= first[doc + 1]
            at, low, high, doc = at[inside], low[inside], high[inside], doc[inside]
            n = high - low
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc_ids.append(np.repeat(doc, n))
            item_ids.append(self.items[entry])
            shifts.append(np.repeat(at, n) - self.places[entry])
        if not doc_ids or not sum(map(len, doc_ids)):
            return
        found = np.unique(np.column_stack([np.concatenate(x) for x in (doc_ids, item_ids, shifts)]), axis=0)
        for doc, item, shift in found.tolist():
            own, end = self.words[item], int(first[doc + 1])
            low, high = max(0, int(first[doc]) - shift), min(len(own), end - shift)
            equal = own[low:high] == h[shift + low : shift + high]
            if stretch := best_stretch(equal, min(len(own), OVERLAP_WORDS)):
                a, b = stretch
                yield doc, item, shift + low + a - int(first[doc]), low + a, b - a, int(equal[a:b].sum())


def best_stretch(equal: np.ndarray, least: int) -> tuple[int, int] | None:
    """Of the stretches of ``least`` words or more, ``SIMILARITY`` of them equal, that of most equal words.

    Unequal words at its ends are left off as far as ``least`` words remain.
    """
    percent = round(100 * SIMILARITY)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    count = np.concatenate([[0], np.cumsum(equal)])
    # For every end the first start from which enough words are equal.
    start = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    got = np.where(np.arange(len(sums)) - start >= least, count - count[start], -1)
    end = int(got.argmax())
    if got[end] < 0:
        return None
    a, b = int(start[end]), end
    while b - a > least and not equal[b - 1]:
        b -= 1
    while b - a > least and not equal[a]:
        a += 1
    return a, b


def indexes(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of all items, in blocks of at most ``limit`` bytes of text unless one item is longer.

    Null texts have no words. Repeated items are found each for itself.
    """
    rows = benchmark.select("item_id", F.lower(text_of(F.col("text"))).alias("text"))
    block = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.countDistinct("item_id", "text")).first()
    n = 1 if size[0] <= limit else 2 * (size[0] // limit)
    while n > 1 and n < 64 * size[1]:
        most = rows.groupBy(block(n).alias("k")).agg(F.sum(F.octet_length("text")).alias("b")).agg(F.max("b")).first()[0]
        if most <= limit:
            break
        n *= 2
    for k in range(n):
        got = rows.filter(block(n) == k).orderBy("item_id", "text").collect() if n > 1 else rows.orderBy("item_id", "text").collect()
        if got:
            yield Index.of([r["item_id"] for r in got], [r["text"] for r in got])


def _scanned(index: Index) -> Callable[[pa.RecordBatch, int], Iterator[tuple]]:
    def scan(batch: pa.RecordBatch, column: int) -> Iterator[tuple]:
        for at, _, data, offsets in slices(*text_arrays(batch, column), NARROW_BYTES):
            if len(data):
                _, _, h, first = words(data, offsets, _APART)
                for doc, *rest in index.overlaps(h, first):
                    yield at + doc, *rest

    return scan


def overlaps(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """Benchmark passages in documents: doc_id, item_id and the overlap of most equal words of the
    two, as start in the document and in the item, length and equal words, counted in words.

    An overlap has ``OVERLAP_WORDS`` words or a whole shorter item, ``SIMILARITY`` of them equal.
    Each holds a hit of one of ``MASKS`` or ``SHORT_MASKS``, from which it is verified word by
    word. Words are lower-cased; punctuation parts them. Items of fewer than ``LEAST_WORDS`` words
    tell nothing.

    Documents are scanned where they lie, once per block of the benchmark, and only overlaps
    are shuffled. Null and empty texts overlap nothing; ids may be null or repeated, and rows
    that repeat an id share a result. Other columns are ignored.
    """
    types = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    schema = f"{types}, doc_start long, item_start long, n_words long, n_equal long"
    parts = []
    for index in indexes(benchmark, limit):
        scan = _scanned(index)

        def rows(batches: Iterator[pa.RecordBatch], scan=scan, index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if got := list(scan(batch, 1)):
                    doc, item, *rest = zip(*got)
                    ids = [batch.column(0).take(pa.array(doc)), pa.array([index.item_ids[i] for i in item])]
                    yield pa.RecordBatch.from_arrays(
                        [*ids, *(pa.array(c, pa.int64()) for c in rest)], ["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"]
                    )

        parts.append(docs.select("doc_id", F.lower(text_of(F.col("text")))).mapInArrow(rows, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    best = F.max(F.struct("n_equal", "n_words", -F.col("doc_start"), "item_start")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("b.col3")).alias("doc_start"), "b.item_start", "b.n_words", "b.n_equal"
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` without an overlap with any benchmark item, with all their columns."""
    text, out = docs.columns.index("text"), docs
    for index in indexes(benchmark, limit):
        scan = _scanned(index)

        def rows(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lowered = pa.array([t.lower() if t else "" for t in batch.column(text).to_pylist()], pa.string())
                keep = np.ones(batch.num_rows, bool)
                keep[[g[0] for g in scan(pa.RecordBatch.from_arrays([lowered], ["text"]), 0)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(rows, docs.schema)
    return out


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
