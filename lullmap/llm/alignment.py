"""Alignment of two tokenizers over the same texts by galloping intersection of token ends."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullmap.llm.common import query, stored, table, text_of
from lullmap.llm.phrases import Tally

# Bytes of text, or token ids, that a task aligns at once.
SLICE = 1 << 21
# Linked id pairs whose counts are broadcast at once, 17 bytes each.
PAIRS = 1 << 22


@dataclass(frozen=True)
class Files:
    """Vocabulary files: byte-level BPE as JSON and as ranks with their pattern, and a piece model."""

    json: str
    ranks: str
    pattern: str
    pieces: str


class Tokens:
    """Both vocabularies: ids of a text, and the bytes of an id."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(files.json)
        self.whole.encode_special_tokens = True
        with open(files.ranks, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        letter = _letter_bytes()
        self.bytes_a = [b""] * self.whole.get_vocab_size()
        for entry, i in self.whole.get_vocab().items():
            self.bytes_a[i] = bytes(map(letter.__getitem__, entry)) if all(c in letter for c in entry) else entry.encode()
        self.bytes_b = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.size_a = np.array(list(map(len, self.bytes_a)), np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        a, b = map(str, range(len(self.bytes_a))), list(map(str, range(len(self.bytes_b))))
        a = list(a)
        # Ids as text with what follows them: A inside and at the end of a group, B inside, at its end and at the document's.
        self.told = [f"{x}{s}".encode() for x, s in [(x, s) for s in ",|" for x in a] + [(x, s) for s in (",", ";", "") for x in b]]

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def ids_a(self, text: str) -> list[int]:
        """The ranks give what the JSON file does; texts beyond the first 256 characters, where rules on letters could differ, go by the latter."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encoded(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text with a space before it; none where either side does not give back its bytes."""
        found_a, found_b = [], self.pieces.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            own = self.ids_a(" " + text) if text else []
            raw = (" " + text).encode()
            same = text and b"".join(map(self.bytes_a.__getitem__, own)) == raw
            same = same and b"".join(map(self.bytes_b.__getitem__, found_b[i])) == raw
            if not same:
                own, found_b[i] = [], []
            found_a.append(own)
        return found_a, found_b


def _letter_bytes() -> dict[str, int]:
    """The bytes that the printable characters of a byte-level vocabulary stand for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def tokens(files: Files) -> Tokens:
    return Tokens(files)


def gallop(wanted: np.ndarray, held: np.ndarray, hint: np.ndarray) -> np.ndarray:
    """First index of sorted ``held`` that is not below each of ``wanted``.

    From its hint every search doubles its step until the place is between two probes, then
    halves that range. All searches step together; those that are through drop out.
    """
    n = len(held)
    if not n:
        return np.zeros(len(wanted), np.int64)
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), n, np.int64)
    at = np.minimum(hint, n - 1)
    below = held[at] < wanted
    low[below], high[~below] = at[below] + 1, at[~below]
    for side, sign in ((np.flatnonzero(below), 1), (np.flatnonzero(~below), -1)):
        step = 1
        while len(side):
            probe = at[side] + sign * step
            side, probe = (x[(probe >= 0) & (probe < n)] for x in (side, probe))
            less = held[probe] < wanted[side]
            low[side[less]] = probe[less] + 1
            high[side[~less]] = probe[~less]
            side = side[less if sign > 0 else ~less]
            step *= 2
    open_ = np.flatnonzero(low < high)
    while len(open_):
        mid = (low[open_] + high[open_]) >> 1
        less = held[mid] < wanted[open_]
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
        open_ = open_[low[open_] < high[open_]]
    return low


class Aligned:
    """Tokens of some documents in a row, of which both sides have the same bytes.

    The ends of the shorter side are searched in the longer one. Common ends cut groups; from
    one rank to the next lie the tokens of the longer side that a token of the shorter overlaps.
    """

    def __init__(self, sizes: tuple[np.ndarray, np.ndarray], ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        none = [np.empty(0, np.int64)]
        self.n = [np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b)]
        self.ids = [np.concatenate(ids or none).astype(np.int64) for ids in (ids_a, ids_b)]
        ends = [np.cumsum(size[ids]) for size, ids in zip(sizes, self.ids)]
        self.short = 0 if len(ends[0]) <= len(ends[1]) else 1
        short, held = ends[self.short], ends[1 - self.short]
        self.doc = np.repeat(np.arange(len(self.n[0])), self.n[self.short])
        own, other = self.n[self.short], self.n[1 - self.short]
        begin = np.cumsum(own) - own
        share = (np.arange(len(short)) - begin[self.doc]) * other[self.doc] // np.maximum(own[self.doc], 1)
        rank = gallop(short, held, (np.cumsum(other) - other)[self.doc] + share)
        common = held[rank] == short if len(short) else np.empty(0, bool)
        self.common = [None, None]
        self.common[self.short] = common
        far = np.zeros(len(held), bool)
        far[rank[common]] = True
        self.common[1 - self.short] = far
        self.first = np.zeros(len(short), np.int64)
        self.first[1:] = rank[:-1] + common[:-1]
        self.links = rank - self.first + 1

    def per_doc(self, values: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        """Sums of 64-bit ``values`` by document, exactly."""
        sums = np.concatenate([[0], np.cumsum(values)])
        edge = np.concatenate([[0], np.cumsum(self.n[self.short] if doc is None else doc)])
        return sums[edge[1:]] - sums[edge[:-1]]

    def pairs(self, width: int) -> np.ndarray:
        """Key a * width + b of every link, in order of the shorter side's tokens."""
        inner = np.repeat(np.arange(len(self.links)), self.links)
        begin = np.cumsum(self.links) - self.links
        outer = self.first[inner] + np.arange(len(inner)) - begin[inner]
        one, two = self.ids[self.short][inner], self.ids[1 - self.short][outer]
        return one * width + two if self.short == 0 else two * width + one

    def told(self, names: list[bytes], width_a: int, width_b: int) -> list[bytes]:
        """Each document's groups as text."""
        group = [np.cumsum(c) - c for c in self.common]
        last = [np.flatnonzero(c) for c in self.common]
        before_b = np.concatenate([[0], last[1][:-1] + 1]) if len(last[1]) else np.zeros(1, np.int64)
        code = np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64)
        code[np.arange(len(self.ids[0])) + before_b[group[0]]] = self.ids[0] + width_a * self.common[0]
        final = np.zeros(len(self.ids[1]), np.int64)
        final[np.cumsum(self.n[1])[self.n[1] > 0] - 1] = 1
        if len(self.ids[1]):
            place = np.arange(len(self.ids[1])) + last[0][group[1]] + 1
            code[place] = 2 * width_a + self.ids[1] + width_b * (self.common[1] + final)
        out, at, code = [], 0, code.tolist()
        for n in (self.n[0] + self.n[1]).tolist():
            out.append(b"".join(map(names.__getitem__, code[at : at + n])))
            at += n
        return out


def _portions(sizes: list[int]) -> Iterator[slice]:
    """Runs of rows of about ``SLICE`` in size."""
    at, room = 0, 0
    for i, n in enumerate(sizes):
        if room and room + n > SLICE:
            yield slice(at, i)
            at, room = i, 0
        room += n
    if at < len(sizes):
        yield slice(at, len(sizes))


def _kind(width: int) -> str:
    return "<u2" if width <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, files: Files) -> DataFrame:
    """Per row: doc_id, counts of tokens, groups and links, digest of the groups, and both sides' ids as bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(files)
        kinds = _kind(len(t.bytes_a)), _kind(len(t.bytes_b))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _portions([len(x) for x in texts]):
                raw = t.encoded(texts[part])
                ids = [[np.array(x, np.int64) for x in side] for side in raw]
                own = Aligned((t.size_a, t.size_b), *ids)
                told = own.told(t.told, len(t.bytes_a), len(t.bytes_b))
                digest = [hashlib.sha256(x).hexdigest() if x else "" for x in told]
                packed = [pa.array([x.astype(k).tobytes() for x in side], pa.binary()) for side, k in zip(ids, kinds)]
                counts = [*own.n, own.per_doc(own.common[own.short]), own.per_doc(own.links)]
                cols = [batch.column(0)[part], *map(pa.array, counts), pa.array(digest, pa.string()), *packed]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids_a", "ids_b"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_a binary, ids_b binary"
    return docs.select("doc_id", text_of(F.col("text"))).mapInArrow(rows, schema)


def _realigned(batch: pa.RecordBatch, files: Files) -> Iterator[tuple[slice, Aligned, int]]:
    t = tokens(files)
    kinds = _kind(len(t.bytes_a)), _kind(len(t.bytes_b))
    raw = [batch.column(name).to_pylist() for name in ("ids_a", "ids_b")]
    for part in _portions([len(a) + len(b) for a, b in zip(*raw)]):
        ids = [[np.frombuffer(x, k) for x in side[part]] for side, k in zip(raw, kinds)]
        yield part, Aligned((t.size_a, t.size_b), *ids), len(t.bytes_b)


def pair_counts(rows: DataFrame, files: Files) -> DataFrame:
    """key, n and best of every linked pair: a * B ids + b, its links, and whether b has no oftener pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, own, width in _realigned(batch, files):
                tally.add(own.pairs(width).view(np.uint64))
        yield from tally.rows()

    found = rows.select("ids_a", "ids_b").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    width = len(tokens(files).bytes_b)
    most = F.max("n").over(Window.partitionBy(F.pmod("key", F.lit(width))))
    return found.withColumn("best", F.col("n") == most)


def align(docs: DataFrame, files: Files, pairs: int = PAIRS) -> DataFrame:
    """How the tokens of two vocabularies lie over each other in every text.

    A is the byte-level vocabulary applied to a space and the text, B the piece vocabulary,
    which puts that space itself. Where tokens of both end at one byte, a group ends. Tokens
    whose bytes overlap are linked, and a pair of ids counts its links in all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair is as
    frequent as any of its B id) and count_sum (the counts of all links' pairs). Null and
    empty texts, and those that either vocabulary does not give back byte by byte, have no
    tokens: zeros and an empty digest. Null ids stay null, repeated rows count and come out
    each for itself, other columns are ignored.

    Ids are stored once, so texts are encoded once; pairs are counted by Spark. Their number is
    bounded by the vocabularies; their counts are broadcast ``pairs`` at a time, and every such
    block adds what it knows of each document's links.
    """
    rows = stored(tokenized(docs, files), "token_ids", compression="zstd")
    counts = stored(pair_counts(rows, files), "pairs")
    blocks = max(-(-counts.count() // pairs), 1)
    block = F.pmod(F.xxhash64("key"), F.lit(blocks))
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i in range(blocks):
        own = counts.filter(block == i).orderBy("key").toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(tuple(own[c].to_numpy() for c in ("key", "n", "best")))
        out = out.mapInArrow(_adder(sent, files), out.schema)
        if i + 1 < blocks:
            out = stored(out, "aligned", compression="zstd")
            sent.unpersist()
    return out.drop("ids_a", "ids_b")


def _adder(sent, files: Files):
    """Add to n_best and count_sum of every row what the pairs of a block give."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            more = np.zeros((2, len(batch)), np.int64)
            for part, own, width in _realigned(batch, files):
                if not len(own.links) or not len(keys):
                    continue
                found, place = np.unique(own.pairs(width), return_inverse=True)
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                known = keys[at] == found
                linked = own.per_doc(own.links)
                for j, values in enumerate((best[at] & known, np.where(known, n[at], 0))):
                    more[j, part] = own.per_doc(values[place].astype(np.int64), linked)
            for j, name in enumerate(("n_best", "count_sum")):
                at = batch.schema.get_field_index(name)
                batch = batch.set_column(at, name, pa.array(batch.column(at).to_numpy() + more[j]))
            yield batch

    return add


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers as vocabularies

    path = vocabularies.path
    files = Files(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, path("piece_bpe_32k.model"))
    return align(table(spark, sf, "documents"), files)
