"""N-gram Jaccard join: linked documents by traversal of prefix trees of their shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullmap.llm.common import NARROW_BYTES, free_name, mixed, query, slices, stored, table, text_arrays, text_of, words
from lullmap.llm.links import components

SHINGLE_WORDS = 5
# Two sets link when NUM * union <= DEN * intersection; kept as whole numbers.
NUM, DEN = 75, 100
# Sets that one task compares at most; larger groups are compared block by block.
BLOCK_SETS = 4096
# Rows up to which a table of ids is broadcast rather than shuffled (8 bytes each).
BROADCAST_IDS = 1_000_000


def least_shared(a, b):
    """Shared shingles that sets of sizes ``a`` and ``b`` need to link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin.

    A text with fewer words than a shingle has one, its whole word sequence; without words none.
    """
    _, _, h, first = words(data, offsets)
    n = len(offsets) - 1
    count = np.diff(first)
    size = np.where(count >= SHINGLE_WORDS, count - SHINGLE_WORDS + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(size)])
    roll = np.zeros(max(0, len(h) - SHINGLE_WORDS + 1), np.uint64)
    step = np.uint64(0xC2B2AE3D27D4EB4F)
    for j in range(SHINGLE_WORDS):
        roll *= step
        roll += h[j : j + len(roll)]
    roll = mixed(roll)
    out = np.empty(start[-1], np.uint64)
    where = np.arange(start[-1]) - np.repeat(start[:-1] - first[:-1], size)
    long = np.repeat(count >= SHINGLE_WORDS, size)
    out[long] = roll[where[long]]
    for d in np.flatnonzero((count > 0) & (count < SHINGLE_WORDS)):
        salted = np.append(h[first[d] : first[d + 1]], np.uint64(count[d]))
        total = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in salted:
                total = total * step + x
        out[start[d]] = mixed(np.array([total ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    for a, b in zip(start[:-1], start[1:]):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[start[:-1][size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[start]


def all_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of any number of texts, in slices of bounded memory."""
    parts = [shingle_sets(d, o) for _, _, d, o in slices(data, offsets, NARROW_BYTES)] or [shingle_sets(data, offsets)]
    sizes = [np.diff(start) for _, start in parts]
    return np.concatenate([sets for sets, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def set_keys(sets: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit key for each set; equal sets have equal keys."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets + np.uint64(0x632BE59BD9B4E019)))])
    return mixed(sums[start[1:]] - sums[start[:-1]] + np.diff(start).astype(np.uint64)).view(np.int64)


_SIX = 6


def _by_bucket(sets: np.ndarray, doc: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Rows (bucket, payload) of shingles and the keys of their sets, six bytes a shingle."""
    bucket = ((sets >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        rows = order[edges[b] : edges[b + 1]]
        own, n = np.unique(doc[rows], return_counts=True)
        low = np.ascontiguousarray(sets[rows].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIX])
        head = np.array([len(own)], "<u4").tobytes()
        yield int(b), head + keys[own].astype("<i8").tobytes() + n.astype("<u4").tobytes() + low.tobytes()


def _from_payloads(payloads) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (six bytes) and set keys of payloads; every pair once."""
    sets, keys = [], []
    for p in payloads:
        n = int(np.frombuffer(p, "<u4", 1)[0])
        own = np.frombuffer(p, "<i8", n, 4)
        count = np.frombuffer(p, "<u4", n, 4 + 8 * n)
        low = np.frombuffer(p, np.uint8, offset=4 + 12 * n).reshape(-1, _SIX)
        wide = np.zeros((len(low), 8), np.uint8)
        wide[:, :_SIX] = low
        sets.append(wide.view("<u8").ravel())
        keys.append(np.repeat(own, count))
    s, k = np.concatenate(sets), np.concatenate(keys)
    order = np.lexsort((k, s))
    s, k = s[order], k[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    return s[new], k[new]


def _degrees(s: np.ndarray) -> np.ndarray:
    """For sorted shingles, how many sets hold each."""
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(s)))
    return np.repeat(n, n)


def _blank(n: int, *types) -> list[pa.Array]:
    return [pa.nulls(n, t) for t in types]


def _first_pass(docs: DataFrame, buckets: int) -> DataFrame:
    """Members (doc_id, n_shingles, key) and, per key, how many shingles other sets share."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "payload", "doc_id", "n", "key"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for at, end, data, offsets in slices(*text_arrays(batch, 1)):
                sets, start = all_sets(data, offsets)
                keys, size = set_keys(sets, start), np.diff(start)
                n = end - at
                # Members travel with the shuffle, in buckets of their own, copies too dealt over all.
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets + (at + np.arange(n)) % buckets, pa.int64()), *_blank(n, pa.binary()), ids.slice(at, n), pa.array(size), pa.array(keys)], names
                )
                new = np.zeros(n, bool)
                for d in np.flatnonzero(size):
                    if keys[d] not in seen:
                        seen.add(keys[d])
                        new[d] = True
                doc = np.repeat(np.arange(n), size)
                use = new[doc]
                if len(seen) > 2_000_000:
                    seen.clear()
                if rows := list(_by_bucket(sets[use], doc[use], keys, buckets)):
                    bucket, payload = zip(*rows)
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(bucket, pa.int64()), pa.array(payload, pa.binary()), *_blank(m, ids.type, pa.int64(), pa.int64())], names
                    )

    def count(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() >= buckets:
            return group.select(["doc_id", "n", "key"]).append_column("shared", pa.nulls(group.num_rows, pa.int64()))
        s, k = _from_payloads(p.as_buffer() for p in group.column("payload"))
        key, n = np.unique(k[_degrees(s) > 1], return_counts=True)
        return pa.table([*_blank(len(key), group.schema.field("doc_id").type, pa.int64()), pa.array(key), pa.array(n)], ["doc_id", "n", "key", "shared"])

    sent = docs.select("doc_id", text_of(F.col("text")).alias("text")).mapInArrow(
        emit, f"bucket long, payload binary, doc_id {id_type}, n long, key long"
    )
    return sent.groupBy("bucket").applyInArrow(count, f"doc_id {id_type}, n long, key long, shared long")


def _live_sets(docs: DataFrame, live: DataFrame, buckets: int) -> DataFrame:
    """key, n, shingles in global order (rarest first) and prefix, for sets that may have a link.

    Shingles are counted over the live sets; one that a single set holds is left out, as it is
    in no intersection. The prefix holds the shingles of which a linked set shares one.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in slices(*text_arrays(batch, 0)):
                sets, start = all_sets(data, offsets)
                doc = np.repeat(np.arange(end - at), np.diff(start))
                if rows := list(_by_bucket(sets, doc, set_keys(sets, start), buckets)):
                    bucket, payload = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(payload, pa.binary())], ["bucket", "payload"])

    def count(group: pa.Table) -> pa.Table:
        s, k = _from_payloads(p.as_buffer() for p in group.column("payload"))
        degree = _degrees(s)
        s, k, degree = s[degree > 1], k[degree > 1], degree[degree > 1]
        s = (s << np.uint64(16)) | np.uint64(group.column("bucket")[0].as_py() & 0xFFFF)
        place = k % buckets
        order = np.argsort(place, kind="stable")
        parts, at = np.unique(place[order], return_index=True)
        cut = np.append(at, len(k))
        rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        packed = [np.array([len(r)], "<i8").tobytes() + b"".join(c[r].astype(t).tobytes() for c, t in ((k, "<i8"), (s, "<u8"), (degree, "<i8"))) for r in rows]
        return pa.table([pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], ["part", "payload"])

    def ordered(shingles: pa.Table, sizes: pa.Table) -> pa.Table:
        k, s, degree = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for p in shingles.column("payload"):
            raw = p.as_buffer()
            m = int(np.frombuffer(raw, "<i8", 1)[0])
            for out, kind, at in ((k, "<i8", 8), (s, "<u8", 8 + 8 * m), (degree, "<i8", 8 + 16 * m)):
                out.append(np.frombuffer(raw, kind, m, at))
        k, s, degree = (np.concatenate(c) for c in (k, s, degree))
        order = np.lexsort((s, degree, k))
        k, s = k[order], s[order]
        keys, at = np.unique(k, return_index=True)
        cut = np.append(at, len(k))
        size = dict(zip(sizes.column("key").to_pylist(), sizes.column("n").to_pylist()))
        rows = []
        for key, a, b in zip(keys.tolist(), cut[:-1], cut[1:]):
            # Texts are fetched by id, so some are of sets that have no link.
            if (n := size.get(key)) is None:
                continue
            # Of the n + 1 - 3/4 n rarest shingles, those that only this set holds come first.
            prefix = n + (-NUM * n // DEN) + 1 - (n - (b - a))
            if prefix > 0:
                rows.append((key, n, s[a:b].tobytes(), s[a : a + prefix].view(np.int64)))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        columns = zip(*rows) if rows else ([], [], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["key", "n", "s", "prefix"])

    count_ids, count_null = live.agg(F.count("rep"), F.count_if(F.col("rep").isNull())).first()
    ids = live.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id"))
    every = docs.select("doc_id", text_of(F.col("text")).alias("text"))
    text = every.join(F.broadcast(ids) if count_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    if count_null:
        text = text.unionByName(every.filter("doc_id IS NULL"))
    parts = text.select("text").mapInArrow(emit, "bucket long, payload binary").groupBy("bucket").applyInArrow(count, "part long, payload binary")
    sizes = live.select(F.pmod("key", F.lit(buckets)).alias("part"), "key", "n")
    return parts.groupBy("part").cogroup(sizes.groupBy("part")).applyInArrow(ordered, "key long, n long, s binary, prefix array<long>")


class Trie:
    """Sets as paths from a root, shared as far as they agree from their most frequent shingle on.

    Sets are arrays of ranks, ascending; nodes lie level by level, each with the ranks that
    lead to it from its parent and the range of sets below it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].tolist()), np.int64)
        self.sets, self.sizes = [sets[i] for i in self.order], sizes[self.order]
        agree = [0]
        for x, y in zip(self.sets, self.sets[1:]):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            agree.append(int(differ[0]) if len(differ) else m)
        agree = np.array(agree, np.int64)
        length = np.array([len(s) for s in self.sets], np.int64)
        levels = []
        open_nodes = [(0, len(self.sets), 0, -1)]
        while open_nodes:
            level, below = [], []
            for low, high, depth, parent in open_nodes:
                to = int(length[low]) if high - low == 1 else int(min(agree[low + 1 : high].min(), length[low]))
                place = len(level)
                level.append((low, high, depth, to, parent))
                if high - low == 1:
                    continue
                at = low
                # Sets that end here come first; the others part by their next rank.
                while at < high and length[at] == to:
                    below.append((at, at + 1, to, place))
                    at += 1
                if at < high:
                    cuts = [at, *(at + 1 + np.flatnonzero(agree[at + 1 : high] == to)).tolist(), high]
                    below += [(a, b, to, place) for a, b in zip(cuts[:-1], cuts[1:])]
            levels.append(level)
            open_nodes = below
        self.levels = []
        for level in levels:
            low, high, depth, to, parent = (np.array(c, np.int64) for c in zip(*level))
            ranks = [self.sets[a][d:t] for a, d, t in zip(low, depth, to)]
            flat = np.concatenate(ranks) if ranks else np.empty(0, np.int64)
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in ranks])]).astype(np.int64)
            last = np.array([self.sets[a][t - 1] if t else -1 for a, t in zip(low, to)], np.int64)
            deepest = np.array([length[a:b].max() for a, b in zip(low, high)]) - to
            smallest = np.array([self.sizes[a:b].min() for a, b in zip(low, high)])
            largest = np.array([self.sizes[a:b].max() for a, b in zip(low, high)])
            self.levels.append((low, high, parent, flat, cuts, last, deepest, smallest, largest))

    def linked(self, q: int, mark: np.ndarray, seen: np.ndarray, same: np.ndarray) -> list[int]:
        """Sets after ``q`` that link with it, but for subtrees all of one group with it.

        ``mark`` is nonzero at the ranks of ``q`` and ``seen`` counts them up to each rank. Overlaps
        are carried from level to level; a node is left when even the longest path below it, or
        all that is left of ``q``, cannot reach what its smallest set needs. ``same`` counts, up
        to each set, those of another group than ``q``.
        """
        size, total = self.sizes[q], seen[-1]
        out: list[int] = []
        before = np.zeros(1, np.int64)
        for low, high, parent, flat, cuts, last, deepest, smallest, largest in self.levels:
            got = before[parent] if parent[0] >= 0 else np.zeros(len(low), np.int64)
            alive = (got >= 0) & (high > q + 1) & (same[high] > same[low])
            alive &= (DEN * largest >= NUM * size) & (NUM * smallest <= DEN * size)
            node = np.flatnonzero(alive)
            state = np.full(len(low), -1, np.int64)
            if len(node):
                length = cuts[node + 1] - cuts[node]
                at = np.repeat(cuts[node] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
                hits = np.concatenate([[0], np.cumsum(mark[flat[at]])])
                ends = np.cumsum(length)
                overlap = got[node] + hits[ends] - hits[ends - length]
                reach = overlap + np.minimum(deepest[node], total - seen[last[node] + 1])
                ok = reach >= least_shared(smallest[node], size)
                state[node[ok]] = overlap[ok]
                leaf = ok & (high[node] - low[node] == 1) & (low[node] > q)
                leaf &= overlap >= least_shared(smallest[node], size)
                out += low[node[leaf]].tolist()
            before = state
            if not (state >= 0).any():
                break
        return out


def linked_sets(sets: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the groups of sets: a spanning forest, not all pairs.

    Each set is looked up in the tree of all; subtrees already grouped with it are passed by.
    """
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    trie = Trie([np.sort(rank[np.searchsorted(values, s)]) for s in sets], sizes)
    n = len(sets)
    group = np.arange(n)
    out = []
    mark = np.zeros(len(values), np.int64)
    for q in range(n):
        own = trie.sets[q]
        other = group != group[q]
        if not other[q + 1 :].any():
            continue
        mark[own] = 1
        seen = np.concatenate([[0], np.cumsum(mark)])
        for x in trie.linked(q, mark, seen, np.concatenate([[0], np.cumsum(other)])):
            if group[x] != group[q]:
                out.append((int(trie.order[q]), int(trie.order[x])))
                group[group == group[x]] = group[q]
        mark[own] = 0
    return out


def _links(sets: DataFrame, clusters: DataFrame, most: int = BLOCK_SETS) -> DataFrame:
    """Links (a, b) between set keys that join all sets of a cluster which link.

    A cluster of up to ``most`` sets is one tree. A larger one is dealt into blocks by key, and
    each pair of blocks is a tree, so that no task holds more than two blocks.
    """

    def join(group: pa.Table) -> pa.Table:
        keys = group.column("key").to_numpy()
        own = [np.frombuffer(p.as_buffer(), "<u8") for p in group.column("s")]
        found = linked_sets(own, group.column("n").to_numpy()) if len(keys) > 1 else []
        a, b = zip(*found) if found else ((), ())
        return pa.table([pa.array(keys[list(a)], pa.int64()), pa.array(keys[list(b)], pa.int64())], ["a", "b"])

    size = clusters.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / (most / 2)).alias("blocks"))
    placed = clusters.join(size, "component").withColumnRenamed("node", "key")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    many = F.col("blocks") > 2
    pair = lambda i: F.struct(F.least(block, i).alias("i"), F.greatest(block, i).alias("j"))
    cells = F.when(many, F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair))
    cells = F.coalesce(cells, F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))))
    placed = placed.withColumn("cell", F.explode(F.array_distinct(cells)))
    return sets.select("key", "n", "s").join(placed, "key").groupBy("component", "cell").applyInArrow(join, "a long, b long")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Sets of five-word shingles link when 100 * intersection >= 75 * union. Equal sets count as
    one, with a 64-bit key. A set can only link if three quarters of its shingles stand in other
    sets: shingles are dealt by hash, counted, and the counts summed by set. Of those sets, two
    that link share a shingle of their prefixes in the order of rarity; sets sharing one form a
    cluster, and each cluster is joined in a prefix tree. What is emitted are links that span
    the groups, never all pairs.

    Texts without words, and null texts, have no shingles and stay alone. Rows with a null id
    link as others do, but never give a group its id; a group of null ids has none. Repeated
    rows each have a row. Other columns are ignored.
    """
    buckets = max(16, 2 * docs.rdd.getNumPartitions())
    first = stored(_first_pass(docs, buckets), "shingles")
    members = first.filter("n IS NOT NULL").select("doc_id", "n", "key")
    shared = first.filter("shared IS NOT NULL").groupBy("key").agg(F.sum("shared").alias("shared"))
    classes = members.filter("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("rep"))
    # A document stands for its set by its id; for sets of null ids only, all texts without an id do.
    live = stored(classes.join(shared, "key").filter(f"{DEN} * shared >= {NUM} * n"), "live")
    sets = stored(_live_sets(docs, live, buckets), "sets")
    held = sets.select("key", F.explode("prefix").alias("p"))
    stars = held.join(held.groupBy("p").agg(F.min("key").alias("center"), F.count(F.lit(1)).alias("c")).filter("c > 1"), "p")
    clusters = stored(components(stars.select(F.col("key").alias("a"), F.col("center").alias("b"))), "clusters")
    found = components(_links(sets, clusters))
    grouped = members.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("group", F.coalesce("component", "key"))
    grouped = stored(grouped.select("doc_id", F.col("n").alias("n_shingles"), "group"), "grouped")
    least = grouped.filter("n_shingles > 0").groupBy("group").agg(F.min("doc_id").alias("least"))
    return (
        grouped.filter("n_shingles > 0").join(least, "group")
        .select("doc_id", "n_shingles", F.col("least").alias("component_id"))
        .unionByName(grouped.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their group, with all their columns.

    Rows of a null id stay, as nothing tells them apart; of rows that repeat an id all stay.
    """
    rest = free_name(docs, "dropped_id")
    dropped = near_groups(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias(rest)).distinct()
    dropped = stored(dropped, "dropped")
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, F.col("doc_id") == F.col(rest), "left_anti")


@query("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_groups(table(spark, sf, "documents"))
