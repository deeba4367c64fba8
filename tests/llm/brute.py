"""Plain versions of the operators, over all documents at once."""

import collections
import hashlib
import re

import xxhash

LONG = "the quick brown fox jumps over the lazy dog and runs away from it " * 900
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"

# Nulls, empties, ties, repeats, near copies, a long text and one of odd characters.
ROWS = [
    (1, BASE, "en"), (2, BASE, None), (3, None, "en"), (4, "", "en"), (5, "  \n", "en"), (None, "no id at all here", "en"),
    (6, BASE.replace("nine", "IX"), "en"), (7, BASE + " eighteen nineteen twenty", "en"), (8, "short text", "en"), (9, "short text", "en"),
    (9, "short text", "en"), (10, LONG, "en"), (11, LONG + "end", "en"), (12, "Ünï 日本 \x00 \x1c 'S <|endoftext|> ﬁ", "xx"),
    (13, BASE.upper(), "en"), (None, BASE, "en"),
]


def frame(spark, rows=ROWS, extra=True):
    """Documents with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = "score double, key long, n long, part long, kept_id long, dropped_id long, kept_sha256 string, bucket long, component_id long, row long"
    data = [(d, t, s, "src0", len(t or "")) for d, t, s in rows]
    if extra:
        schema = f"{schema}, {more}"
        data = [(*r, 0.5, 1, 2, 3, 4, 5, "x", 6, 7, 8) for r in data]
    return spark.createDataFrame(data, schema)


def shingles(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(texts):
    """Index -> (set size, smallest index reachable) for a list of texts."""
    sets = [shingles(t) for t in texts]
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in holders[g] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def repeats(rows, least=50):
    """(id, bytes, removed, spans, digest of the rest) for rows (id, text); null ids come last."""
    order = lambda d: float("inf") if d is None else d
    held, out = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            held[w] = min(held.get(w, float("inf")), order(d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if held[b[i : i + least]] < order(d):
                gone[i : i + least] = b"\1" * least
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def selected(data, gram=16, window=32):
    """(hash, place) of the k-grams that winnowing selects in bytes."""
    if not data:
        return []
    n = max(len(data) - gram + 1, 1)
    h = [xxhash.xxh64(data[i : i + gram], seed=42).intdigest() >> 32 & 0x7FFFFFFF for i in range(n)]
    out = set()
    for s in range(max(n - window + 1, 1)):
        own = range(s, min(s + window, n))
        least = min(h[i] for i in own)
        out.add(max(i for i in own if h[i] == least))
    return [(h[i], i) for i in sorted(out)]


def edit_trail(rows, gram=16, window=32):
    """Fingerprint rows of (id, text), equal rows counting as one in the order of documents."""
    null = lambda d: "null" if d is None else str(d)
    order = sorted({(d is not None, d or 0, hashlib.md5(f"{null(d)}:{t or ''}".encode()).digest(), t or "") for d, t in rows})
    after = {(x[0] and x[1], x[3]) if x[0] else (None, x[3]): y for x, y in zip(order, order[1:] + order[:1])}
    text = lambda keys: " ".join(f"{h:x}:{p}" for h, p in keys)

    def like(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    out = []
    for d, t in rows:
        t = t or ""
        has, next_id, _, following = after[(d, t)]
        quarter = len(t) // 4
        edited = t[: len(t) - quarter] + following[:quarter]
        own, changed, other = (selected(x.encode(), gram, window) for x in (t, edited, following))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((d, len(t), digest, text(own), text(changed), like(own, changed), like(own, other), next_id if has else None))
    return out


def collocations(rows, least=10, most=3, first=2000, covered=50):
    """Rows of (language, text) to (lang, rank, phrase, a, l, r, n, score)."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).decode()
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        got = []
        for p, a in found.items():
            if p in longer and 100 * longer[p] >= covered * a:
                continue
            s, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            got.append((-s, -a, " ".join(p).encode(), l, r))
        got = sorted(got)[:first]
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(got)]
    return out


def alignment(rows, encode_a, encode_b):
    """Rows of (id, text); the encoders give (id, bytes) of each token, A of a space and the text."""
    per, often = [], collections.Counter()
    for d, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = (encode_a(t), encode_b(t)) if t else ([], [])
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, p, q in spans[1] if s < q and p < e]
        ends = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            near = [",".join(str(i) for i, _, e in side if lo < e <= hi) for side in spans]
            groups.append("|".join(near))
        often.update(links)
        per.append((d, a, b, groups, links))
    best = collections.Counter()
    for (_, j), n in often.items():
        best[j] = max(best[j], n)
    return [
        (d, len(a), len(b), len(g), len(x), sum(often[p] == best[p[1]] for p in x), sum(often[p] for p in x),
         hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, x in per
    ]
