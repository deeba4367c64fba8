"""The registered queries and the pipeline on the smallest tables, against SQL or plain versions."""

import os
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import brute
import check_oracles
import corpus_pipeline

from lullmap.llm import ORACLES, QUERIES, common, decontaminate, quality


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, con, sf, name):
    assert check_oracles.compare(spark, con, name, QUERIES[name], ORACLES[name], sf) is None


def test_op1(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for d, x in texts}
    got = QUERIES["op1_packing"](spark, sf).toPandas().sort_values(["doc_id", "start"])
    assert got.sequence_id.is_unique
    for d, own in got.groupby("doc_id"):
        at = 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(want[d]) // 4
            assert zlib.crc32(want[d][4 * at : 4 * (at + r.length)]) == r.ids_crc32
            at += r.length
        assert at == len(want[d]) // 4
    assert set(got.doc_id) == set(want)


def test_op2(spark, sf, texts):
    assert sorted(tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, sf).collect()) == sorted(brute.repeats(texts))


def test_op7(spark, sf, texts):
    ids = [d for d, _ in texts]
    want = [(d, n, ids[root]) for d, (n, root) in zip(ids, brute.groups([t for _, t in texts]))]
    assert sorted(tuple(r) for r in QUERIES["op7_jaccard_join"](spark, sf).collect()) == want


@pytest.mark.parametrize("name,label,least", [("op3_quality_classifier", "quality", 0.9), ("op6_toxicity", "toxic", 0.9)])
def test_held_out(spark, con, name, label, least):
    """Learnt on the larger table's rows, right on those held out."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES[name](spark, sf).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, labels[d]) for d, r in got.items() if d in labels and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert sum(p == y for p, y in held) >= least * len(held) and len(held) > 50


def test_pipeline(spark, sf, texts):
    """Each stage does to its input what the plain version does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    trees = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, trees).filter(f"score >= {quality.CUT}").collect()}
    rows = [(d, t or "") for d, t in texts if d in good]
    last = {t: d for d, t in rows}
    rows = [(d, t) for d, t in rows if last[t] == d]
    rows = [r for i, (r, (_, root)) in enumerate(zip(rows, brute.groups([t for _, t in rows]))) if root == i]
    leaks = {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    want = {d for d, _ in rows if d not in leaks}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want
    assert len(want) > 50 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_stages_hand_few_bytes_to_python(spark, sf):
    """Long texts reach Python in small batches, and a limit of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    for name, stage in corpus_pipeline.STAGES:
        if name == "exact_dedup":
            continue
        spark.conf.unset(key)
        stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert max(got) < 5_000_000 and sum(got) > 15_000_000, name
    spark.conf.set(key, "1000000")
    common.small_batches(spark)
    assert int(spark.conf.get(key).rstrip("b")) == 1_000_000
    spark.conf.unset(key)


def test_stages_take_awkward_rows(spark, sf):
    for rows in (brute.ROWS, []):
        docs = brute.frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0
