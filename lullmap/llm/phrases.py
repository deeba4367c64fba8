"""Phrase collocations: candidates that frequent parts allow, counted by double-array tries."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lullmap.llm.common import _LOWER, mixed, prefix_sums, query, slices, span_hash, stored, table, text_arrays, text_of

LEAST = 10
WORDS = 3
TOP = 2000
# Percent of a phrase's occurrences from which a longer one stands for it.
COVERED = 50
UNKNOWN = "und"
# Bits of a table of hashes that may be frequent; more hashes only make it less sharp.
TABLE_BITS = 26
# Bytes of phrases in one trie; a trie has no more nodes than that.
TRIE_BYTES = 1 << 22
# Tries that a task walks its texts through in one pass.
TRIES_AT_ONCE = 4
# Where tries are more than are walked in one pass, each is cut into so many, which the places come to.
DEALT_TRIES = 16
# Different hashes that a task holds before it hands on what it has counted.
HELD = 1 << 22
# Bytes of different phrases at places that a task holds before it hands them on, and that are walked at once.
HELD_BYTES = 1 << 24

_BREAK = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
# Bytes as they stand in a phrase: A-Z lowered, what parts words a space, what parts pieces a line feed.
_PLAIN = bytes(_LOWER).translate(bytes(0x0A if c in _BREAK else 0x20 if c == 0x09 else c for c in range(256)))
# The bits of a word's last eight bytes or less, by their number.
_OF_EIGHT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Words of more bytes are hashed together byte by byte, others in steps of eight.
LONG_WORD = 64


@functools.lru_cache(maxsize=4096)
def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as plain bytes, a line feed after each; start and end of the words there, first word of each text."""
    plain = np.frombuffer(np.insert(data, offsets[1:], 0x0A).tobytes().translate(_PLAIN), np.uint8)
    inside = (plain != 0x20) & (plain != 0x0A)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[:1].any():
        edge = np.append(0, edge)
    start, end = edge[::2], edge[1::2]
    return plain, start, end, np.searchsorted(start, offsets + np.arange(len(offsets)))


def word_hashes(plain: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each word, the same wherever it stands."""
    padded = np.append(plain, np.zeros(8, np.uint8))
    eight = np.ndarray(len(plain) + 1, "<u8", padded, strides=(1,))
    size = end - start
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    which, at, left = np.flatnonzero(size <= LONG_WORD), start, size
    if len(which) < len(size):
        at, left = start[which], size[which]
    own = h[which]
    while len(which):
        own = mixed((own ^ (eight[at] & _OF_EIGHT[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15))
        h[which] = own
        more = np.flatnonzero(left > 8)
        which, at, left, own = which[more], at[more] + 8, left[more] - 8, own[more]
    many = np.flatnonzero(size > LONG_WORD)
    if len(many):
        after = np.cumsum(size[many])
        begin = after - size[many]
        data = plain[np.arange(after[-1]) + np.repeat(start[many] - begin, size[many])]
        h[many] = span_hash(prefix_sums(data), begin, after)
    return h


class Words:
    """The words of a slice of texts: salted hashes, which are followed by one of their piece, and a buffer of them.

    In the buffer words stand in order, followed by a space, or by a line feed at the end of a
    piece; so a phrase is a stretch of the buffer.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.plain, self.start, self.end, self.first = word_edges(data, offsets)
        self.text = np.repeat(np.arange(len(langs)), np.diff(self.first))
        salts = np.array([_salt(x) for x in langs], np.uint64)
        self.hash = word_hashes(self.plain, self.start, self.end) + salts[self.text]
        # A line feed, one ends each text too, parts the words around it.
        after = np.searchsorted(self.start, np.flatnonzero(self.plain == 0x0A))
        self.same = np.ones(len(self.start), bool)
        self.same[after[after > 0] - 1] = False
        self.made = {1: (self.hash, np.ones(len(self.hash), bool))}

    @functools.cached_property
    def owner(self) -> np.ndarray:
        """A class of each text in 16 bits, the same wherever the text lies."""
        sums = np.append(np.uint64(0), np.cumsum(self.hash))
        return (mixed(sums[self.first[1:]] - sums[self.first[:-1]]) >> np.uint64(48)).astype(np.uint16)

    @functools.cached_property
    def after(self) -> np.ndarray:
        return np.cumsum(self.end - self.start + 1) - 1

    @functools.cached_property
    def begin(self) -> np.ndarray:
        return self.after - (self.end - self.start)

    @functools.cached_property
    def buffer(self) -> np.ndarray:
        # Each word and the byte after it.
        kept = (self.plain != 0x20) & (self.plain != 0x0A)
        kept[self.end] = True
        buffer = self.plain[kept]
        buffer[self.after] = np.where(self.same, 0x20, 0x0A)
        return buffer

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each place, and where they lie in one piece."""
        if k not in self.made:
            h, whole = self.grams(k - 1)
            n = max(len(self.hash) - k + 1, 0)
            h = h[:n] * np.uint64(0x9E3779B97F4A7C15)
            h += self.hash[k - 1 :]
            self.made[k] = mixed(h), whole[:n] & self.same[k - 2 : k - 2 + n]
        return self.made[k]


def in_table(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - TABLE_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def possible(found: Words, k: int, tables: dict[int, Broadcast]) -> tuple[np.ndarray, np.ndarray]:
    """Places of phrases of ``k`` words all of whose tabled parts may be frequent, and their hashes."""
    h, fits = found.grams(k)
    n, fits = len(h), fits.copy()
    for part, bits in tables.items():
        if part <= k:
            own = in_table(bits.value, found.grams(part)[0])
            for i in range(k - part + 1):
                fits &= own[i : i + n]
    place = np.flatnonzero(fits)
    return place, h[place]


class Tally:
    """Counts of hashes and, where told, the class of a text that holds each, kept sorted and small."""

    def __init__(self):
        self.columns: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, owner: np.ndarray | None = None) -> None:
        if owner is None:
            keys, counts = np.unique(h, return_counts=True)
            own = [keys, counts.astype(np.int32)]
        else:
            # Any text's class will do, so the order among equal hashes is left open.
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            own = [h[first], np.diff(np.append(first, len(h))).astype(np.int32), owner[order[first]]]
        self._hold(own)
        if self.size > 2 * HELD:
            self._hold(self.total())

    def _hold(self, own: list[np.ndarray]) -> None:
        self.columns = self.columns or [[] for _ in own]
        for column, x in zip(self.columns, own):
            column.append(x)
        self.size += len(own[0])

    def total(self) -> list[np.ndarray]:
        """What was added, which is held no longer: a column at a time, so that few are there twice."""
        columns, self.columns, self.size = self.columns, [], 0
        if not columns:
            return [np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)]
        for i, parts in enumerate(columns):
            columns[i] = np.concatenate(parts)
            parts.clear()
        order = np.argsort(columns[0], kind="stable")
        columns[0] = columns[0][order]
        first = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])[: len(order)])
        columns[0] = columns[0][first]
        if len(first):
            columns[1] = np.add.reduceat(columns[1][order], first, dtype=np.int64)
        order = order[first]
        return [*columns[:2], *(x[order] for x in columns[2:])]

    def rows(self) -> Iterator[pa.RecordBatch]:
        columns = self.total()
        keys = columns[0].view(np.int64)
        for i in range(0, len(keys), 100_000):
            part = [x[i : i + 100_000] for x in (keys, *columns[1:])]
            kinds = [pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(part, kinds)], ["key", "n", "owner"][: len(part)])


def found_words(batch: pa.RecordBatch) -> Iterator[tuple[Words, list[str]]]:
    """Words of the texts (second column) of a batch and the language (first) of each text."""
    langs = batch.column(0).to_pylist()
    for at, end, data, offsets in slices(*text_arrays(batch, 1)):
        yield Words(data, offsets, langs[at:end]), langs[at:end]


def counted(texts: DataFrame, k: int, tables: dict[int, Broadcast]) -> DataFrame:
    """key, n, owner: how often a hash of ``k`` words stands in the texts, where its parts may be
    frequent, and the class of a text that holds it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for found, _ in found_words(batch):
                place, h = possible(found, k, tables)
                tally.add(h, found.owner[found.text[place]])
                if tally.size > HELD:
                    yield from tally.rows()
        yield from tally.rows()

    rows = texts.mapInArrow(count, "key long, n long, owner int")
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))


def owned(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The hashes with the class of a text in their upper bits."""
    return h ^ (owner.astype(np.uint64) << np.uint64(48))


def bit_table(keys: DataFrame) -> np.ndarray:
    """The hashes of ``keys`` as a table of 2**TABLE_BITS bits, put together by Spark, 16 MB at most."""
    at = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    word = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(key, {64 - TABLE_BITS}) & 63 AS INT)))").alias("b"))
    got = word.toArrow()
    bits = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return bits


def candidates(texts: DataFrame, least: int = LEAST, most: int = WORDS) -> DataFrame:
    """lang, phrase: every phrase of two to ``most`` words that stands ``least`` times, and its words.

    Level by level: a phrase is counted only where all its parts may be frequent, by a hash of
    64 bits, so that its count is never too low. The words of a frequent hash are told by the
    texts of one class that holds it, not by every task; so no frequent phrase is left out unless
    another one has its hash.
    """
    tables, frequent = {}, []
    for k in range(1, most + 1):
        got = stored(counted(texts, k, tables).filter(F.col("n") >= least).select("key", "owner"), "frequent")
        tables[k] = texts.sparkSession.sparkContext.broadcast(bit_table(got))
        if k > 1:
            frequent.append(got)
    keys = functools.reduce(DataFrame.union, frequent)
    told_by = keys.select(F.col("key").bitwiseXOR(F.shiftleft(F.col("owner").cast("long"), 48)).alias("key"))
    tellers = texts.sparkSession.sparkContext.broadcast(bit_table(told_by))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Hashes told before, by their low bits; one that displaced another is told again, no harm.
        seen = np.zeros(HELD, np.uint64)
        slot = lambda h: (h & np.uint64(HELD - 1)).astype(np.int64)
        for batch in batches:
            for found, langs in found_words(batch):
                for k in range(2, most + 1):
                    place, h = possible(found, k, tables)
                    new = in_table(tellers.value, owned(h, found.owner[found.text[place]])) & (seen[slot(h)] != h)
                    h, first = np.unique(h[new], return_index=True)
                    place = place[new][first]
                    seen[slot(h)] = h
                    raw = found.buffer.tobytes()
                    phrase = [raw[a:b] for a, b in zip(found.begin[place].tolist(), found.after[place + k - 1].tolist())]
                    lang = [langs[t] for t in found.text[place].tolist()]
                    cols = [pa.array(h.view(np.int64)), pa.array(lang, pa.string()), pa.array(phrase, pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, ["key", "lang", "phrase"])

    # What tasks tell alike is one row before it meets the frequent hashes, dealt by hash for both;
    # a phrase has one hash, so it stays one row.
    told = texts.mapInArrow(tell, "key long, lang string, phrase string").repartition("key").distinct()
    phrases = stored(told.join(keys, "key", "left_semi").select("lang", "phrase"), "told")
    for table_ in [*tables.values(), tellers]:
        table_.destroy()
    own = phrases.select("lang", F.explode(F.split("phrase", " ")).alias("phrase"))
    return phrases.union(own).distinct()


class Trie:
    """A double-array trie over bytes.

    The child of state s by byte c is ``base[s] + c`` if ``check`` holds s there. A phrase ends
    in a child by byte 0x0A, which no phrase holds; ``base`` has its number there.
    """

    END = 0x0A

    def __init__(self, base: np.ndarray, check: np.ndarray):
        self.base, self.check = base, check

    @classmethod
    def of(cls, entries: list[bytes], numbers: np.ndarray) -> Trie:
        """A trie of different ``entries`` without byte 0x0A at their end."""
        order = sorted(range(len(entries)), key=entries.__getitem__)
        numbers = np.asarray(numbers, np.int64)[order]
        ended = [entries[i] + b"\n" for i in order]
        data = np.frombuffer(b"".join(ended), np.uint8)
        size = np.array([len(e) for e in ended], np.int64)
        start = np.cumsum(size) - size
        parent, code, ends = [], [], np.zeros(len(ended), np.int64)
        node, nodes = np.zeros(len(ended), np.int64), 1
        live, fresh = np.arange(len(ended)), np.zeros(len(ended), bool)
        if len(fresh):
            fresh[0] = True
        depth = 0
        while len(live):
            # An entry opens a node where it differs from the live one before it, here or earlier.
            byte = data[start[live] + depth]
            fresh[live[1:]] |= byte[1:] != byte[:-1]
            opens = fresh[live]
            parent.append(node[live][opens])
            code.append(byte[opens])
            node[live] = nodes - 1 + np.cumsum(opens)
            nodes += int(opens.sum())
            done = size[live] == depth + 1
            ends[live[done]] = node[live[done]]
            # A shorter entry comes first, so what precedes one that ends differs from what follows.
            follows = live[1:][done[:-1]]
            live = live[~done]
            fresh[follows] = True
            depth += 1
        parent = np.concatenate(parent) if parent else np.empty(0, np.int64)
        code = np.concatenate(code).astype(np.int64) if code else np.empty(0, np.int64)
        base, check, slot = _placed(parent, code, nodes)
        base[slot[ends]] = numbers
        return cls(base, check)

    def walk(self, entry: bytes) -> int:
        """The state after ``entry`` from the root, or -1."""
        s = 0
        for c in entry:
            t = int(self.base[s]) + c
            if self.check[t] != s:
                return -1
            s = t
        return s

    def count(self, buffer: np.ndarray, begin: np.ndarray, state: np.ndarray, into: np.ndarray, times: np.ndarray | None = None) -> None:
        """Count in ``into`` the phrases that start at ``begin`` from the given states, each once or so many times.

        All places advance together, a byte at a time. At the end of a word a phrase may end.
        """
        alive = state >= 0
        at, state = begin[alive], state[alive]
        n = None if times is None else times[alive]
        accepted, weights = [], []
        while len(at):
            byte = buffer[at]
            over = (byte == 0x20) | (byte == Trie.END)
            s = state[over]
            last = self.base[s] + Trie.END
            right = self.check[last] == s
            accepted.append(self.base[last[right]])
            if n is not None:
                weights.append(n[over][right])
            goes = np.flatnonzero(byte != Trie.END)
            state = state[goes]
            after = self.base[state] + byte[goes]
            kept = self.check[after] == state
            goes = goes[kept]
            at, state = at[goes] + 1, after[kept]
            if n is not None:
                n = n[goes]
        if accepted:
            found = np.concatenate(accepted)
            if n is None:
                into += np.bincount(found, minlength=len(into))
            else:
                # Whole numbers, exact as doubles below 2**53.
                into += np.bincount(found, np.concatenate(weights), len(into)).astype(np.int64)


def _placed(parent: np.ndarray, code: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bases, checks and the slot of each node, for edges to nodes 1, 2, ... in that order.

    States of many children find room first, at places drawn at random until all their
    children fit; states of one child take what is left.
    """
    room = 3 * nodes // 2 + 1024
    base, check = np.zeros(room + 256, np.int32), np.full(room + 256, -1, np.int32)
    used = np.zeros(room + 256, bool)
    used[0] = True
    claim = np.empty(room + 256, np.int64)
    slot = np.zeros(nodes, np.int64)
    by_parent = np.argsort(parent, kind="stable")
    parents, first, degree = np.unique(parent[by_parent], return_index=True, return_counts=True)
    offset = np.zeros(nodes, np.int64)
    rng = np.random.default_rng(1)
    for k in np.unique(degree)[::-1]:
        who = np.flatnonzero(degree == k)
        edges = by_parent[first[who][:, None] + np.arange(k)]
        if k == 1:
            free = np.flatnonzero(~used[256 : room + 256])[: len(who)] + 256
            offset[parents[who]] = free - code[edges[:, 0]]
            slot[edges[:, 0] + 1] = free
            used[free] = True
            continue
        while len(who):
            at = rng.integers(0, room, len(who))
            slots = at[:, None] + code[edges]
            fits = ~used[slots].any(1)
            # Of those that want one slot in a round, the first has it.
            rows = np.flatnonzero(fits)
            flat, owner = slots[rows].ravel(), np.repeat(rows, k)
            claim[flat[::-1]] = owner[::-1]
            won = rows[(claim[flat] == owner).reshape(len(rows), k).all(1)]
            offset[parents[who[won]]] = at[won]
            slot[edges[won].ravel() + 1] = slots[won].ravel()
            used[slots[won].ravel()] = True
            left = np.ones(len(who), bool)
            left[won] = False
            who, edges = who[left], edges[left]
    base[slot] = offset
    check[slot[1:]] = slot[parent]
    return base, check, slot


def phrase_counts(texts: DataFrame, wanted: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """lang, phrase, f: how often each wanted phrase stands in the texts, overlaps included.

    A few tries of about ``trie_bytes`` of text are broadcast and the texts walked through them
    where they lie. As each pass reads all texts, there is but one: with more phrases the places
    come to the tries, see ``dealt_counts``. Either way the work follows the texts.
    """
    spark = texts.sparkSession
    schema = "lang string, phrase string, head long, pair long, key long, size int"
    headed = stored(wanted.select("lang", "phrase").mapInArrow(_with_heads, schema), "phrases")
    size = F.octet_length("phrase") + F.octet_length("lang") + 2
    heads = headed.groupBy("head").agg(F.sum(size).alias("bytes"), F.max("size").alias("size"))
    large = F.collect_list(F.when(F.col("bytes") > trie_bytes // 8, F.col("head")))
    total, most, large = heads.agg(F.sum("bytes"), F.max("size"), large).first()
    tries = -(-(total or 0) // trie_bytes)
    if not tries:
        return wanted.select("lang", "phrase", F.lit(0).cast("long").alias("f")).limit(0)
    if tries > TRIES_AT_ONCE:
        wanted_bits = spark.sparkContext.broadcast(bit_table(headed.select("key")))
        cells = max(tries * DEALT_TRIES, texts.rdd.getNumPartitions())
        counts = stored(dealt_counts(texts, headed, wanted_bits, most, cells), "counts")
        wanted_bits.destroy()
        return counts
    return stored(broadcast_counts(texts, headed, tries, large), "counts")


def broadcast_counts(texts: DataFrame, headed: DataFrame, tries: int, large: list[int]) -> DataFrame:
    """lang, phrase, f, counted in one pass through all tries.

    The phrases are dealt by their first word; those of a ``large`` first word are dealt by hash
    over all tries. Tries are built by tasks, and every task walks the places of its texts through
    the trie of their word, or through all, and hands on the counts of its shard, which are summed.
    """
    # As numbers_of() has it.
    block = F.pmod(F.shiftrightunsigned("head", 1), F.lit(tries))
    if large:
        block = F.when(F.col("head").isin(large), F.pmod(F.xxhash64("lang", "phrase"), F.lit(tries))).otherwise(block)

    def build(rows: pa.Table) -> pa.Table:
        """The phrases with their numbers, and a row with their trie."""
        number = np.arange(len(rows), dtype=np.int32)
        made = _trie(rows)
        phrases = rows.select(["block", "lang", "phrase"]).append_column("number", pa.array(number))
        row = {"block": rows["block"][:1], "number": pa.array([len(rows)], pa.int32())}
        row |= {"base": pa.array([made.base.tobytes()], pa.binary()), "check": pa.array([made.check.tobytes()], pa.binary())}
        return pa.concat_tables([phrases, pa.table(row)], promote_options="default").select(names)

    names = ["block", "number", "lang", "phrase", "base", "check"]
    schema = "block int, number int, lang string, phrase string, base binary, check binary"
    built = headed.select(block.cast("int").alias("block"), "lang", "phrase").groupBy("block").applyInArrow(build, schema)
    built = stored(built, "tries")
    sent = []
    for i in range(tries):
        for row in built.filter((F.col("block") == i) & F.col("base").isNotNull()).select("base", "check", "number").collect():
            sent.append(texts.sparkSession.sparkContext.broadcast((i, row["base"], row["check"], row["number"])))
        row = None
    shards = texts.mapInArrow(_walker(sent, tries, large), "block int, number int, f long")
    counts = stored(shards.groupBy("block", "number").agg(F.sum("f").alias("f")), "shards")
    for own in sent:
        own.destroy()
    phrases = built.filter(F.col("phrase").isNotNull()).select("block", "number", "lang", "phrase")
    return phrases.join(counts, ["block", "number"]).select("lang", "phrase", "f")


def dealt_counts(texts: DataFrame, headed: DataFrame, wanted_bits: Broadcast, most: int, cells: int) -> DataFrame:
    """lang, phrase, f, counted in small tries, ``cells`` of words and as many of phrases, to which the places come.

    A place is the longest wanted phrase that begins there, as far as a table of hashes tells, and
    equal ones of a task come once with their number. Phrases of several words and their places
    are dealt by the hash of the first two words, so a frequent word lies in many cells; words have
    cells of their own, as the trie of a phrase would count them again.
    """
    # As Places has it.
    cell = F.pmod(F.shiftrightunsigned("pair", 1), F.lit(cells)) + F.when(F.col("size") > 1, cells).otherwise(0)
    phrases = headed.select(cell.cast("int").alias("cell"), "lang", "phrase")
    places = texts.mapInArrow(_dealer(wanted_bits, most, cells), "cell int, langs array<string>, lang binary, size binary, n binary, bytes binary")

    def count(rows: pa.Table, places: pa.Table) -> pa.Table:
        sums = np.zeros(len(rows), np.int64)
        if len(rows):
            trie = _trie(rows)
            root = functools.cache(lambda x: trie.walk(x.encode() + b"\n"))
            for state, size, n, buffer in _places(places, root):
                trie.count(buffer, np.cumsum(size) - size, state, sums, n)
        held = pa.table({"lang": rows["lang"], "phrase": rows["phrase"], "f": pa.array(sums)})
        return held.filter(pa.array(sums > 0))

    return phrases.groupBy("cell").cogroup(places.groupBy("cell")).applyInArrow(count, "lang string, phrase string, f long")


def _trie(rows: pa.Table) -> Trie:
    langs, phrases = rows["lang"].to_pylist(), rows["phrase"].to_pylist()
    return Trie.of([f"{x}\n{p}".encode() for x, p in zip(langs, phrases)], np.arange(len(rows)))


def _with_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, the hashes of its first word, of its first two (of one, if there is no more) and of all, and its words."""
    for batch in batches:
        made = [[np.empty(0, np.uint64)] * 3 + [np.empty(0, np.int32)]]
        for found, _ in found_words(batch):
            size = np.diff(found.first).astype(np.int32)
            h = [found.hash[found.first[:-1]] for _ in range(3)]
            for k in range(2, int(size.max(initial=0)) + 1):
                own = size >= k
                h[2][own] = found.grams(k)[0][found.first[:-1][own]]
                if k == 2:
                    h[1] = h[2].copy()
            made.append([*h, size])
        columns = [np.concatenate(x) for x in zip(*made)]
        columns = [pa.array(x.view(np.int64)) for x in columns[:3]] + [pa.array(columns[3])]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["lang", "phrase", "head", "pair", "key", "size"])


def _stretches(buffer: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a buffer, joined."""
    after = np.cumsum(size)
    return buffer[np.arange(after[-1] if len(after) else 0) + np.repeat(begin - (after - size), size)]


class Places:
    """Different phrases at the places of a task's texts, each with its number, cell and language."""

    def __init__(self, cells: int):
        self.cells, self.held, self.bytes = cells, [], 0
        self.langs: dict[str, int] = {}

    def add(self, found: Words, langs: list[str], place: np.ndarray, words: np.ndarray, h: np.ndarray, pair: np.ndarray) -> None:
        _, first, n = np.unique(h, return_index=True, return_counts=True)
        place, h = place[first], h[first]
        begin = found.begin[place]
        size = found.after[place + words[first] - 1] + 1 - begin
        data = _stretches(found.buffer, begin, size)
        data[np.cumsum(size) - 1] = Trie.END
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)[found.text[place]]
        cell = ((pair[first] >> np.uint64(1)) % np.uint64(self.cells)).astype(np.int32) + self.cells * (words[first] > 1)
        self.held.append((h, n, cell, lang, size, data))
        self.bytes += len(data) + 24 * len(h)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What was added, a row for each cell; it is held no longer."""
        if not self.held:
            return
        held, self.held, self.bytes = self.held, [], 0
        h, n, cell, lang, size, data = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        n = np.add.reduceat(n[order], first)
        own = order[first]
        by = np.argsort(cell[own], kind="stable")
        own, n = own[by], n[by]
        begin = np.cumsum(size) - size
        cells, cuts = np.unique(cell[own], return_index=True)
        langs = list(self.langs)
        for c, a, b in zip(cells.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
            some = own[a:b]
            columns = [lang[some].astype("<i4"), size[some].astype("<i4"), n[a:b].astype("<i8"), _stretches(data, begin[some], size[some])]
            columns = [pa.array([c], pa.int32()), pa.array([langs], pa.list_(pa.string())), *(pa.array([x.tobytes()], pa.binary()) for x in columns)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "langs", "lang", "size", "n", "bytes"])


def _dealer(wanted_bits: Broadcast, most: int, cells: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, places = wanted_bits.value, Places(cells)
        for batch in batches:
            for found, langs in found_words(batch):
                words = np.zeros(len(found.hash), np.int64)
                longest = found.hash.copy()
                for k in range(2, most + 1):
                    h, fits = found.grams(k)
                    at = np.flatnonzero(fits & in_table(bits, h))
                    words[at], longest[at] = k, h[at]
                one = np.flatnonzero(in_table(bits, found.hash))
                many = np.flatnonzero(words)
                place = np.concatenate([one, many])
                pair = found.hash[one] if not len(many) else np.concatenate([found.hash[one], found.grams(2)[0][many]])
                h = np.concatenate([found.hash[one], longest[many]])
                places.add(found, langs, place, np.concatenate([np.ones(len(one), np.int64), words[many]]), h, pair)
                if places.bytes > HELD_BYTES:
                    yield from places.rows()
        yield from places.rows()

    return deal


def _places(rows: pa.Table, root) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """States of the language, sizes, numbers and bytes of places, ``HELD_BYTES`` or a row at once."""
    held = []
    for r in range(len(rows)):
        lang, size, n, data = (rows[c][r].as_buffer() for c in ("lang", "size", "n", "bytes"))
        roots = np.array([root(x) for x in rows["langs"][r].as_py()], np.int64)
        held.append((roots[np.frombuffer(lang, "<i4")], np.frombuffer(size, "<i4"), np.frombuffer(n, "<i8"), np.frombuffer(data, np.uint8)))
        if r + 1 == len(rows) or sum(len(x[3]) for x in held) > HELD_BYTES:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []


def numbers_of(heads: np.ndarray, tries: int, large: np.ndarray) -> np.ndarray:
    """The trie that has the phrases of each first word; -1 where all may have some."""
    number = ((heads >> np.uint64(1)) % np.uint64(tries)).astype(np.int64)
    if len(large):
        number[large[np.minimum(np.searchsorted(large, heads), len(large) - 1)] == heads] = -1
    return number


def _walker(sent: list, count: int, large: list[int]):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.sort(np.array(large, np.int64).view(np.uint64))
        tries = []
        for block, base, check, size in (b.value for b in sent):
            trie = Trie(np.frombuffer(base, np.int32), np.frombuffer(check, np.int32))
            tries.append((block, trie, np.zeros(size, np.int64), {}))
        for batch in batches:
            for found, langs in found_words(batch):
                own = numbers_of(found.hash, count, spread)
                for block, trie, sums, roots in tries:
                    for x in set(langs) - roots.keys():
                        roots[x] = trie.walk(x.encode() + b"\n")
                    place = np.flatnonzero((own == block) | (own < 0))
                    state = np.array([roots[x] for x in langs], np.int64)[found.text[place]]
                    trie.count(found.buffer, found.begin[place], state, sums)
        for block, _, sums, _ in tries:
            number = np.flatnonzero(sums)
            cols = [np.full(len(number), block, np.int32), number.astype(np.int32), sums[number]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["block", "number", "f"])

    return walk


def word_totals(texts: DataFrame) -> DataFrame:
    """lang, n: all word occurrences of each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, _, data, offsets in slices(*text_arrays(batch, 1)):
                for x, n in zip(langs[at:], np.diff(word_edges(data, offsets)[3]).tolist()):
                    sums[x] = sums.get(x, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "n"])

    return texts.mapInArrow(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, a: the phrases of two words and more that stand ``least`` times."""
    size = F.size(F.split("phrase", " "))
    return counts.filter(F.col("f") >= least).select("lang", "phrase", size.alias("size"), F.col("f").alias("a")).filter("size > 1")


def scored(counts: DataFrame, least: int = LEAST, phrases: DataFrame | None = None) -> DataFrame:
    """lang, phrase, size, a, l, r, score of ``phrases``, or all frequent ones, by their lowest-scoring cut."""
    own = (frequent(counts, least) if phrases is None else phrases).withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "size", "a", "k",
        part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"),
    )
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).drop("left")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]).drop("right")
    # Counts below 10**15, so a product of two and a million stays below 10**37.
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")), wide("l") * wide("r"))
    cuts = cuts.withColumn("score", score.cast("long"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(best).select("lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def without_parts(phrases: DataFrame, most: int = WORDS, covered: int = COVERED) -> DataFrame:
    """Drop phrases that stand inside a longer one with at least ``covered`` percent of their count."""
    w, spans = F.split("phrase", " "), []
    for size in range(3, most + 1):
        for k in range(2, size):
            spans += [F.when(F.col("size") == size, F.array_join(F.slice(w, i, k), " ")) for i in range(1, size - k + 2)]
    if not spans:
        return phrases
    inner = phrases.select("lang", "a", F.explode(F.array(*spans)).alias("phrase")).filter("phrase IS NOT NULL")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    out = phrases.join(inner, ["lang", "phrase"], "left")
    return out.filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")


def top(phrases: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each language with their rank; each is first cut down by shares of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = phrases.withColumn("share", share)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order)))
    some = some.filter(F.col("rank") <= most)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= most).drop("share")


def collocations(
    docs: DataFrame, least: int = LEAST, most: int = WORDS, first: int = TOP, trie_bytes: int = TRIE_BYTES
) -> DataFrame:
    """Each language's ``first`` phrases of two to ``most`` words, by how much oftener they stand than their parts let expect.

    A text is lower-cased (A-Z), cut into pieces at marks and line ends and those into words. A
    phrase with a occurrences is cut into two parts with l and r; its score is a million times
    a * a / (l * r), rounded down, of the cut where that is least, the first of equal ones.
    Phrases inside a longer one with half their occurrences are left out.

    Null texts count as empty and null languages as ``und``; ids and other columns are ignored,
    repeated rows count each. Returns lang, rank, phrase, a, l, r, n (words of the language), score.
    """
    lang = F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.select(lang, text_of(F.col("text")).alias("text"))
    counts = phrase_counts(texts, candidates(texts, least, most), trie_bytes)
    ranked = top(scored(counts, least, without_parts(frequent(counts, least), most)), first)
    return ranked.join(word_totals(texts), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op12_collocations",
    rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWERED}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    q AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    u AS (SELECT lang, piece, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM q),
    v AS (SELECT lang, w, lead(w) OVER s AS x, lead(w, 2) OVER s AS y FROM u WINDOW s AS (PARTITION BY piece ORDER BY i)),
    g AS (SELECT lang, 1 AS k, w AS phrase FROM v UNION ALL SELECT lang, 2, w || ' ' || x FROM v WHERE x IS NOT NULL
      UNION ALL SELECT lang, 3, w || ' ' || x || ' ' || y FROM v WHERE y IS NOT NULL),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
    x AS (SELECT c.*, s.cut, array_to_string(w[1:s.cut], ' ') AS lp, array_to_string(w[s.cut + 1:k], ' ') AS rp
      FROM c, (VALUES (1), (2)) AS s(cut) WHERE s.cut < k),
    y AS (SELECT x.lang, x.k, x.phrase, a, lf.f AS l, rf.f AS r,
        (1000000::HUGEINT * a * a) // (lf.f::HUGEINT * rf.f) AS score,
        row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY (1000000::HUGEINT * a * a) // (lf.f::HUGEINT * rf.f), cut) AS nth
      FROM x JOIN f lf ON lf.lang = x.lang AND lf.phrase = x.lp JOIN f rf ON rf.lang = x.lang AND rf.phrase = x.rp),
    i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
      FROM c WHERE k = 3) GROUP BY ALL),
    z AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank FROM y
      LEFT JOIN i ON i.lang = y.lang AND i.phrase = y.phrase AND y.k = 2 WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
      CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(table(spark, sf, "documents"))
