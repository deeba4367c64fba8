"""Toxicity: a learnt weighted lexicon, matched by Aho-Corasick in folded text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import held_out, query, table, text_of

# Labelled rows that lexicon and weights are learnt from at most; they bound terms and phrases too.
TRAIN_ROWS = 20_000
CUT = 0.5
# Letters of a word stem, and toxic documents that a term must stand in.
STEM = range(3, 9)
LEAST_DOCS = 4
# Log-odds of a term, and the same at the lower end of its 90 % interval.
LEAST_WEIGHT, LEAST_SURE = 2.3, 1.2

# Digits and look-alike letters, and the Latin letters they are read as.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "ս": "u", "ɡ": "g", "ı": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x",
}
IN_WORD = {"@": "a", "$": "s", "!": "i"}
_HIDDEN = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD])
_FOLD = str.maketrans({**DIGITS, **LOOK_ALIKES, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}}) | _HIDDEN
_BETWEEN = re.compile(r"(?<=[a-z])[@$!](?=[a-z])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, with homoglyphs, digits and signs inside words read as letters."""
    text = text.lower().translate(_FOLD)
    return _BETWEEN.sub(lambda m: IN_WORD[m[0]], text)


@dataclass
class Lexicon:
    """Terms and weights. A term ending in a space is a whole word, any other the start of one."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    model: tuple[float, ...] = (-4.0, 1.0, 0.0, 0.0)
    _automaton: object = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            made = ahocorasick.Automaton()
            for term in self.weights:
                made.add_word(term.rstrip(" "), (len(term.rstrip(" ")), term))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, str]]:
        """Words that hold a term: start, end and the term of largest weight; exceptions left out.

        Whole word and stem of the same letters are one pattern, told apart by what follows.
        """
        if not self.weights:
            return []
        found: dict[int, tuple[int, str]] = {}
        weights, n = self.weights, len(folded)
        for last, (size, term) in self.automaton().iter(folded):
            start = last + 1 - size
            if start and folded[start - 1].isalnum():
                continue
            open_end = last + 1 < n and folded[last + 1].isalnum()
            stem = term.rstrip(" ")
            options = [t for t in ((stem,) if open_end else (stem, stem + " ")) if t in weights]
            if options:
                best = max(options, key=weights.__getitem__)
                if start not in found or weights[best] > weights[found[start][1]]:
                    found[start] = (last + 1, best)
        out = []
        for start, (end, term) in sorted(found.items()):
            while end < n and folded[end].isalnum():
                end += 1
            if self.exceptions and any(p in self.exceptions for p in phrases(folded, start, end)):
                continue
            out.append((start, end, term))
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Weight, weight against length, and number of different terms.

        A repeated term counts twice at most, weight ends at 60 and number at 12: beyond that
        a document is toxic as it is, and the score levels off.
        """
        folded = fold(text)
        often = Counter(t for _, _, t in self.hits(folded))
        weight = sum(self.weights[t] * min(n, 2) for t, n in often.items())
        length = folded.count(" ") + 1
        return min(weight, 60.0) / 10, 10 * weight / (length + 50), min(len(often), 12) / 4

    def score(self, text: str) -> float:
        z = self.model[0] + sum(m * f for m, f in zip(self.model[1:], self.features(text)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def phrases(folded: str, start: int, end: int) -> list[str]:
    """The word in [start, end) with its left and with its right neighbour, looked for within 40 characters."""
    word = folded[start:end]
    left = _WORD.findall(folded[max(0, start - 40) : start])
    right = _WORD.findall(folded[end : end + 40])
    return [f"{w[-1]} {word}" for w in [left] if w] + [f"{word} {w[0]}" for w in [right] if w]


def terms_of(text: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(fold(text))):
        if word[0].isalpha() and len(word) >= 3:
            out.add(word + " ")
            out.update(word[:k] for k in STEM if k <= len(word))
    return out


def _counted(sample: DataFrame, terms, least: int) -> DataFrame:
    """Toxic and clean documents per term; terms are counted per partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else clean).update(terms(text))
            if len(toxic) + len(clean) > 400_000:
                yield rows(toxic, clean)
                toxic, clean = Counter(), Counter()
        yield rows(toxic, clean)

    def rows(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        names = list(toxic.keys() | clean.keys())
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([toxic[t] for t in names], pa.int64()), pa.array([clean[t] for t in names], pa.int64())],
            ["term", "toxic", "clean"],
        )

    counts = sample.select("text", "y").mapInArrow(count, "term string, toxic long, clean long")
    return counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.greatest("toxic", "clean") >= least)


def chosen(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log-odds of terms that are toxic beyond chance, each as long as its documents allow.

    A stem gives way to a longer term of nearly all its documents; a longer term is left out
    where a chosen stem of it weighs as much.
    """
    count = {t: a for t, a, _ in rows}
    weight, sure = {}, {}
    for t, a, b in rows:
        weight[t] = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        sure[t] = weight[t] - 1.64 * float(np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    absorbed = {
        term[:k]
        for term in count
        for k in range(STEM.start, len(term))
        if count.get(term[:k], 0) * 0.9 <= count[term] and term[:k] in count
    }
    out: dict[str, float] = {}
    for term in sorted(weight, key=lambda t: (len(t), t)):
        shorter = [term[:k] for k in range(STEM.start, len(term)) if term[:k] in out]
        if term not in absorbed and sure[term] >= LEAST_SURE and not any(weight[s] >= weight[term] - 1.0 for s in shorter):
            out[term] = min(weight[term], 6.0)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_ROWS) -> Lexicon:
    """Learn terms, exception phrases and weights from at most ``most`` rows not held out.

    The rows are those of smallest hashed id. Terms are counted by Spark; what reaches the
    driver is three numbers per row and the terms and phrases that ``LEAST_DOCS`` of these rows
    share and their labels tell apart. Labels with a null id or label are left out; of repeated
    ids the largest label counts, and of the texts of one id the first in byte order.
    """
    sample = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    rows = docs.select("doc_id", text_of(F.col("text")).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).cache()
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        rows.unpersist()
        rate = (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon(model=(float(np.log(rate / (1 - rate))), 0.0, 0.0, 0.0))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    likely = _counted(rows, terms_of, LEAST_DOCS).filter((F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_WEIGHT))
    likely = likely.orderBy("term").collect()
    lexicon = Lexicon(chosen([tuple(r) for r in likely], toxic, clean))

    def around(text: str) -> set[str]:
        folded = fold(text)
        return {p for s, e, _ in lexicon.hits(folded) for p in phrases(folded, s, e)}

    fine = _counted(rows, around, 3).filter("clean >= 3 AND toxic * 4 <= clean").collect()
    lexicon.exceptions = frozenset(r["term"] for r in fine)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([lexicon.features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, x)], ["doc_id", "y", "a", "b", "c"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "y").mapInArrow(measure, f"doc_id {id_type}, y int, a double, b double, c double")
    got = got.orderBy("doc_id").toPandas()
    rows.unpersist()
    lexicon.model = logistic(got[["a", "b", "c"]].to_numpy(float), got["y"].to_numpy(float))
    return lexicon


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[float, ...]:
    """Intercept and coefficients by Newton's method, coefficients held at zero or more."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.01] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty @ w)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(map(float, w))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out and the score of every row; null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [lexicon.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", text_of(F.col("text"))).mapInArrow(rows, f"doc_id {id_type}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    lexicon = fit(docs, table(spark, sf, "labels"))
    return score(docs, lexicon).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
