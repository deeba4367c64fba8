"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import NARROW_BYTES, held_out, mixed, query, slices, table, text_arrays, words

# Labelled rows that the trees are grown on at most.
TRAIN_ROWS = 20_000
CUT = 0.3

# Classes of bytes whose shares of a text are statistics of it.
_CLASSES = ("lower", "upper", "digit", "space", "newline", "high", "stop", "mark", "bar", "symbol", "other")
_CLASS_OF = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _chars in {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "high": range(128, 256),
    "stop": b".,;:",
    "mark": b"!?",
    "bar": b"|<>{}[]\\/",
    "symbol": b"#$%&*+=@^_~",
}.items():
    _CLASS_OF[list(_chars)] = _CLASSES.index(_name)

STATISTICS = (
    "bytes", "words", "word_bytes", "longest_word", "bytes_a_line", "new_words", "repeats", "new_lines",
    "top_word", "pairs_new", "symbol_kinds", *_CLASSES,
)
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[[0x0A, 0x0D]] = True


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of every document, and how often its most frequent one occurs."""
    count, top = np.zeros(n), np.zeros(n)
    if len(doc):
        order = np.lexsort((key, doc))
        d, k = doc[order], key[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
        at = np.flatnonzero(first)
        runs = np.diff(np.append(at, len(d)))
        count = np.bincount(d[at], minlength=n).astype(float)
        np.maximum.at(top, d[at], runs)
    return count, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each of the concatenated texts; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    per = np.maximum(size, 1)
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    kinds = len(_CLASSES)
    counts = np.bincount(doc_of_byte * kinds + _CLASS_OF[data], minlength=n * kinds).reshape(n, kinds)
    start, end, h, first = words(data, offsets)
    total = np.diff(first).astype(float)
    some = np.maximum(total, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, end - start)
    distinct, top = _distinct(doc, h, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pair = mixed(h[1:] * np.uint64(3) + h[:-1])
    inner = doc[1:] == doc[:-1]
    pairs, _ = _distinct(doc[1:][inner], pair[inner], n)
    ls, le, lh, lfirst = words(data, offsets, _NOT_NEWLINE)
    lines = np.diff(lfirst).astype(float)
    new_lines, _ = _distinct(np.repeat(np.arange(n), np.diff(lfirst)), lh, n)
    tail = np.zeros(n)
    if len(end):
        ends_odd = np.isin(_CLASS_OF[data[end - 1]], [_CLASSES.index(c) for c in ("symbol", "mark", "bar")])
        tail = np.bincount(doc, ends_odd, n) / some
    columns = [
        np.log1p(size), np.log1p(total), (counts[:, 0] + counts[:, 1] + counts[:, 5]) / some, longest,
        size / np.maximum(lines, 1), distinct / some, np.bincount(doc, same, n) / some,
        new_lines / np.maximum(lines, 1), top / some, pairs / np.maximum(some - 1, 1), tail,
    ]
    return np.column_stack([*columns, counts / per[:, None]])


def all_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``statistics`` of any number of texts, in slices of bounded memory."""
    parts = [statistics(d, o) for _, _, d, o in slices(data, offsets, NARROW_BYTES)]
    return np.concatenate(parts) if parts else np.empty((0, len(STATISTICS)))


@dataclass
class Trees:
    """Boosted trees as arrays: node ``i`` of a tree has the children 2i + 1 and 2i + 2.

    A row goes right where its feature exceeds the threshold. Nodes that were not split carry
    an infinite threshold, so all rows end on the lowest level, whose values are ``leaves``.
    """

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaves: np.ndarray  # trees x 2 ** depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaves.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaves):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - (2**depth - 1)]
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.15, bins: int = 64,
    least: float = 2.0, shrink: float = 1.0,
) -> Trees:
    """Fit ``Trees`` to 0/1 labels by Newton boosting on binned features.

    ``least`` is the smallest hessian sum of a child, ``shrink`` the ridge on leaf values.
    Without rows, or with one label only, the trees are empty and score a smoothed base rate.
    """
    n, d = x.shape
    inner, low = 2**depth - 1, 2**depth
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, low)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    out_f, out_t, out_l = [], [], []
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k, lo = 2**level, 2**level - 1
            at = node - lo
            best, choice = np.zeros(k), np.full(k, -1)
            bin_of = np.zeros(k, np.int64)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                cell = at * bins + binned[:, j]
                gs = np.bincount(cell, g, k * bins).reshape(k, bins).cumsum(1)
                hs = np.bincount(cell, h, k * bins).reshape(k, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + shrink) + (ga - gs) ** 2 / (ha - hs + shrink) - ga**2 / (ha + shrink)
                gain[(hs < least) | (ha - hs < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(k), top] > best + 1e-9
                best[better], choice[better], bin_of[better] = gain[np.arange(k), top][better], j, top[better]
            for i in np.flatnonzero(choice >= 0):
                feature[lo + i] = choice[i]
                threshold[lo + i] = cuts[choice[i]][bin_of[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        values = -rate * np.bincount(leaf, g, low) / (np.bincount(leaf, h, low) + shrink)
        margin += values[leaf]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(values)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_l), base)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_ROWS) -> Trees:
    """Grow trees on at most ``most`` labelled documents that are not held out.

    The rows are those of smallest hashed id, so a rerun takes the same. Only their statistics
    reach the driver. Labels with a null id or label are left out; of repeated ids the largest
    label counts, and of repeated documents one.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    names = [f"f{j}" for j in range(len(STATISTICS))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = all_statistics(*text_arrays(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, x.T)], ["doc_id", "y", *names])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = (
        docs.select("doc_id", F.col("text"))
        .join(F.broadcast(sample), "doc_id")
        .select("doc_id", "text", "y")
        .mapInArrow(rows, f"doc_id {id_type}, y int, " + ", ".join(f"{c} double" for c in names))
        .dropDuplicates(["doc_id"])
        .orderBy("doc_id")
        .toPandas()
    )
    return grow(got[names].to_numpy(float).reshape(-1, len(names)), got["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out and the score of every row; null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = trees.score(all_statistics(*text_arrays(batch, 1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, trees: Trees, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` scoring ``cut`` or more, with all their columns."""
    place = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = trees.score(all_statistics(*text_arrays(batch, place))) >= cut
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(rows, docs.schema)


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    trees = fit(docs, table(spark, sf, "labels"))
    return score(docs, trees).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
