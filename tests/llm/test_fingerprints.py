"""Fingerprints, collocations and alignment against plain versions, on tables and on awkward rows."""

import random
import re
import sys
import tracemalloc
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute
from pyspark.sql import functions as F

from lullmap.llm import QUERIES, alignment, phrases, winnowing

PAIRS = [(d, t) for d, t, _ in brute.ROWS]
key = lambda r: tuple((x is not None, x) for x in r)


@pytest.fixture(scope="module")
def docs(spark):
    return brute.frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# Winnowing


@pytest.mark.parametrize("gram,window", [(16, 32), (4, 8), (3, 1)])
def test_winnowing_rows(docs, gram, window):
    got = winnowing.edit_trail(docs, gram, window).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.edit_trail(PAIRS, gram, window), key=key)


def test_winnowing_table(spark, sf, texts):
    got = QUERIES["op11_winnowing"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(brute.edit_trail(texts))


def test_winnowing_of_a_text_over_the_step_and_over_short_places(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("ab cé") for _ in range(70_000))
    rows = [(1, text), (2, text[100:]), (3, "ab")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, winnowing.edit_trail(df).collect())) == brute.edit_trail(rows)
    keys = {r.doc_id: r for r in winnowing.fingerprints(df).collect()}
    one, two = ({k & ~0xFFFFFFFF for k in (x + 0xFFFFFFFF for x in keys[d]["keys"])} for d in (1, 2))
    assert len(one & two) > 0.99 * len(two)


def test_winnowing_finds_every_shared_passage(spark):
    """Texts that share a passage of gram + window - 1 bytes share a selected k-gram."""
    rng = random.Random(6)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(40):
        same = make(8 + 16 - 1)
        rows += [(2 * i, make(rng.randrange(60)) + same + make(rng.randrange(60))), (2 * i + 1, make(rng.randrange(60)) + same)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    h = winnowing.hashes(winnowing.fingerprint(F.col("text").cast("binary"), 8, 16))
    got = {r.doc_id: set(r.h) for r in df.select("doc_id", h.alias("h")).collect()}
    assert all(got[2 * i] & got[2 * i + 1] for i in range(40))


def test_winnowing_empty_table_and_one_document(spark):
    assert winnowing.edit_trail(brute.frame(spark, [])).count() == 0
    row = winnowing.edit_trail(spark.createDataFrame([(7, "a text of its own, long enough for windows and grams")], "doc_id long, text string")).first()
    assert row.next_id == 7 and row.near_next == 1.0


# Collocations


def test_double_array_trie_holds_what_it_was_given():
    rng = random.Random(3)
    piece = lambda: rng.choice([b"a", b"b", b"c ", b"\x01", b"z", bytes([rng.randrange(11, 256)])])
    entries = list({b"".join(piece() for _ in range(rng.randrange(1, 9))) for _ in range(3000)} | {b"x" * 500})
    rng.shuffle(entries)
    trie = phrases.Trie.of(entries, np.arange(len(entries)))
    for i, e in enumerate(entries):
        assert trie.base[trie.walk(e + b"\n")] == i
    held = set(entries)
    others = [b"".join(piece() for _ in range(rng.randrange(6))) for _ in range(3000)]
    assert all((trie.walk(e + b"\n") >= 0) == (e in held) for e in others)
    assert phrases.Trie.of([], np.empty(0)).walk(b"a") == -1


@pytest.mark.parametrize("owned", [False, True])
def test_tally_counts_with_and_without_owners(owned):
    tally, rng = phrases.Tally(), np.random.default_rng(4)
    parts = [rng.integers(0, 50, n).astype(np.uint64) for n in (200, 0, 90)]
    for h in parts:
        tally.add(h, *[(h * 2).astype(np.int32)] * owned)
    got = [r for batch in tally.rows() for r in batch.to_pylist()]
    keys, n = np.unique(np.concatenate(parts), return_counts=True)
    own = [{"owner": 2 * k} if owned else {} for k in keys.tolist()]
    assert got == [{"key": k, "n": m} | o for k, m, o in zip(keys.tolist(), n.tolist(), own)]
    assert not list(tally.rows())


def test_tally_sums_up_within_bounded_memory(monkeypatch):
    rng, n = np.random.default_rng(5), 1 << 16
    monkeypatch.setattr(phrases, "HELD", 32 * n)
    parts = [rng.integers(0, 1 << 62, n).astype(np.uint64) for _ in range(40)]
    owners = [(h & np.uint64(0xFFFF)).astype(np.uint16) for h in parts]
    tally = phrases.Tally()
    tracemalloc.start()
    for h, owner in zip(parts, owners):
        tally.add(h, owner)
    rows = 0
    for batch in tally.rows():
        assert batch.schema.types == [pa.int64(), pa.int64(), pa.int32()]
        assert (batch.column(0).to_numpy().view(np.uint64) & np.uint64(0xFFFF) == batch.column(2).to_numpy()).all()
        rows += batch.num_rows
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(np.unique(np.concatenate(parts)))
    assert most < 60 * n * len(parts), most / n / len(parts)


def collocation_rows(rows, **more):
    return sorted(brute.collocations(rows, **more))


@pytest.mark.parametrize("least,most,first", [(2, 3, 2000), (1, 4, 2000), (2, 3, 5)])
def test_collocations_rows(docs, least, most, first):
    rows = [(lang, t) for _, t, lang in brute.ROWS]
    got = phrases.collocations(docs, least, most, first).collect()
    assert sorted(map(tuple, got)) == collocation_rows(rows, least=least, most=most, first=first)


def test_collocations_in_many_tries(spark):
    rng = random.Random(8)
    vocabulary = ["Aa", "b", "été", "日本", "x" * 300, "d\x00d", "ab", "a"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", " \x0b"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(120)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    for size in (phrases.TRIE_BYTES, 20_000):
        assert sorted(map(tuple, phrases.collocations(df, 3, trie_bytes=size).collect())) == collocation_rows(rows, least=3)


def test_words_hash_alike_wherever_they_stand():
    rng = random.Random(6)
    vocabulary = ["a", "b", "ab", "a\x00", "a\x00\x00", "été", "日本", "x" * 8, "x" * 9, "x" * 16 + "y", "z" * phrases.LONG_WORD, "z" * 200, "z" * 199 + "y"]
    seps = [" ", "\t", "  ", ". ", " , ", "\n", "\x0b"]
    texts = ["", *("".join(rng.choice(vocabulary) + rng.choice(seps) for _ in range(rng.randrange(40))) for _ in range(40)), "", "Ab", "aB x", ""]
    raw = [t.encode() for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in raw]))
    found = phrases.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, ["en"] * len(raw))
    split = [[re.findall("[^ \t]+", p.lower()) for p in re.split("[.,;:!?\n-\r]", t)] for t in texts]
    assert found.buffer.tobytes().decode() == "".join(" ".join(p) + "\n" for t in split for p in t if p)
    words = [w for t in split for p in t for w in p]
    assert [found.buffer[a:b].tobytes().decode() for a, b in zip(found.begin, found.after)] == words
    assert np.diff(found.first).tolist() == [sum(map(len, t)) for t in split]
    assert len(set(zip(words, found.hash.tolist()))) == len(set(words)) == len(set(found.hash.tolist()))


def test_collocation_places_walk_the_trie_of_their_word_only(monkeypatch):
    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    text = " ".join(random.Random(2).choices(words, k=500))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": [text]})
    heads = next(phrases.found_words(batch))[0].hash
    one = dict(zip(text.split(), heads.tolist()))
    pairs, tries, large = [f"{a} {b}" for a in words for b in words], 3, {"h"}
    spread = np.array([one[w] for w in large], np.uint64)
    dealt = phrases.numbers_of(np.array([one[p[0]] for p in pairs], np.uint64), tries, spread)
    dealt = np.where(dealt < 0, np.arange(len(pairs)) % tries, dealt)
    own = [[p for p, b in zip(pairs, dealt) if b == i] for i in range(tries)]
    made = [phrases.Trie.of([f"en\n{p}".encode() for p in x], np.arange(len(x))) for x in own]
    sent = [SimpleNamespace(value=(i, t.base.tobytes(), t.check.tobytes(), len(x))) for i, (t, x) in enumerate(zip(made, own))]
    walked, count = [], phrases.Trie.count
    monkeypatch.setattr(phrases.Trie, "count", lambda self, buffer, begin, *a: (walked.append(len(begin)), count(self, buffer, begin, *a)))
    rows = [r for b in phrases._walker(sent, tries, spread.view(np.int64).tolist())([batch]) for r in b.to_pylist()]
    got = {own[r["block"]][r["number"]]: r["f"] for r in rows}
    assert got == Counter(f"{a} {b}" for a, b in zip(text.split(), text.split()[1:]))
    assert sum(walked) == 500 + (tries - 1) * text.split().count("h")


def test_collocation_texts_are_read_once_for_any_number_of_tries(spark, monkeypatch):
    """Words and phrases in one cell, phrases without their beginnings, one word before most others, places held in parts."""
    rng = random.Random(12)
    vocabulary = ["a"] * 9 + ["b", "ab", "été", "x" * 90, *(f"w{i}" for i in range(12))]
    rows = [(rng.choice(["en", "fr", ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\t", ", "]) for _ in range(rng.randrange(90)))) for _ in range(50)]
    held = Counter()
    for lang, text in rows:
        for words in (re.findall("[^ \t]+", piece) for piece in text.split(",")):
            held.update((lang, " ".join(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    wanted = rng.sample(sorted(held), 700) + [("en", "nowhere"), ("", "a nowhere")]
    texts = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    phrase_rows, passes, plain = spark.createDataFrame(wanted, "lang string, phrase string"), [], type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, *a, **k: (passes.append(self is texts), plain(self, *a, **k))[1])
    monkeypatch.setattr(phrases, "HELD_BYTES", 5_000, raising=False)
    monkeypatch.setattr(phrases, "DEALT_TRIES", 1, raising=False)
    for size in (1 << 22, 4_000, 1_500):
        passes.clear()
        got = phrases.phrase_counts(texts, phrase_rows, size).collect()
        assert {(r.lang, r.phrase): r.f for r in got} == {w: held[w] for w in wanted if held[w]} and len(got) == len(wanted) - 2
        assert sum(passes) == 1, size


def test_collocation_phrases_meet_the_counts_of_their_parts_once(spark):
    counts = spark.createDataFrame([("en", "a", 30), ("en", "b", 30), ("en", "a b", 20), ("en", "a b a", 12), ("en", "b a", 13)], "lang string, phrase string, f long")
    assert [r.phrase for r in phrases.without_parts(phrases.frequent(counts)).collect()] == ["a b a"]
    kept = phrases.without_parts(phrases.frequent(counts), covered=62)
    plan = phrases.scored(counts, phrases=kept)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3
    own = ("en", "a b", 2, 20, 30, 30, 10**6 * 400 // 900), ("en", "a b a", 3, 12, 20, 30, 10**6 * 144 // 600)
    assert sorted(map(tuple, phrases.scored(counts, phrases=kept).collect())) == list(own)


def test_collocation_scores_past_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 7)], "lang string, phrase string, f long")
    assert phrases.scored(counts).first().score == 10**6 * (big - 7) ** 2 // (big * (big + 1))


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(brute.frame(spark, [])).count() == 0


# Alignment


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as v

    return alignment.Files(v.path("byte_bpe_50k.json"), v.path("byte_bpe_50k.tiktoken"), v.PATTERN, v.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoders(files):
    """The two vocabularies by their own libraries only."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(files.json), sentencepiece.SentencePieceProcessor(model_file=files.pieces)
    a.encode_special_tokens = True
    letter = alignment._letter_bytes()

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (
        lambda t: [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids],
        lambda t: [(i, piece(i)) for i in b.encode(t)],
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_gallop():
    rng = np.random.default_rng(0)
    for _ in range(60):
        held = np.unique(rng.integers(0, 1000, rng.integers(0, 200)))
        wanted = rng.integers(0, 1000, 50)
        hint = rng.integers(0, len(held) + 5, 50)
        assert (alignment.gallop(wanted, held, hint) == np.searchsorted(held, wanted)).all()


@pytest.mark.parametrize("pairs", [alignment.PAIRS, 700])
def test_alignment_rows(spark, files, encoders, pairs):
    rows = [(d, t[:3000] if t else t) for d, t in PAIRS]
    rows += [(20, "a▁b"), (21, "</s> <|endoftext|> <unk>\n\n  日本語 😀"), (22, " "), (23, "y" * 900), (24, "naïve façade №5 Ωmega")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_a int, ids_a string").repartition(4)
    got = alignment.align(df, files, pairs).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.alignment(rows, *encoders), key=key)


def test_alignment_table(spark, sf, texts, encoders):
    short = [(d, t) for d, t in texts if len(t or "") < 4000]
    got = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, sf).collect()}
    assert set(got) == {d for d, _ in texts}
    for d, a, b, groups, links, *_, digest in brute.alignment(short, *encoders):
        assert (got[d].n_a, got[d].n_b, got[d].n_groups, got[d].n_links, got[d].groups_sha256) == (a, b, groups, links, digest)


def test_alignment_of_an_empty_table(spark, files):
    assert alignment.align(brute.frame(spark, []), files).count() == 0
