import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from echoloom.llm import classifier as ops
from tests.llm.conftest import AWKWARD
from tests.llm.test_quality_rules import prose


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = prose(rng, rng.randrange(20, 80)).split()
        kind = rng.randrange(3)
        text = " ".join(words) if good else " ".join(
            [[w + "$$$" for w in words], [w.upper() + "!!" for w in words], words[:1] * len(words)][kind])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return rows, labels


def remainder(i):
    return zlib.crc32(str(i).encode()) % 4


def test_held_out_accuracy_and_calibration(spark, docs):
    rows, labels = corpus(random.Random(1), 800)
    rows += AWKWARD
    given = spark.createDataFrame(labels + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = ops.score_documents(docs(rows), given).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (remainder(r.doc_id) == 2) for r in got if r.doc_id is not None)
    truth = {i: q for i, q, _ in labels}
    told = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth and r.doc_id > 10]
    assert len(told) > 150 and np.mean([p == t for _, t, p in told]) > 0.95
    assert np.mean([(s - t) ** 2 for s, t, _ in told]) < 0.05


def test_held_out_labels_are_not_read(spark, docs):
    rows, labels = corpus(random.Random(2), 200)
    kinds = "doc_id long, quality int, toxic int"
    flipped = [(i, 1 - q if remainder(i) == 2 else q, t) for i, q, t in labels]
    a, b = (sorted(ops.score_documents(docs(rows), spark.createDataFrame(x, kinds)).collect())
            for x in (labels, flipped))
    assert a == b


def test_word_vectors_equal_brute_force(docs):
    rows = [(1, "one two, two TWO"), (2, None), (3, "one"), (4, "three one two")]
    index = ops.index_vectors().astype(int)
    sums = np.zeros((ops.BUCKETS, ops.SIZE))
    lines = [["one", "two", ",", "two", "^", "two"], ["one"], ["three", "one", "two"]]
    for line in lines:
        at = [ops._CAPITALS if u == "^" else ops._bucket(u) for u in line]
        for i, b in enumerate(at):
            for j in range(max(0, i - ops.REACH), min(len(at), i + ops.REACH + 1)):
                if j != i:
                    sums[b] += index[at[j]]
    want = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1) + 0.5 * index
    assert ops.word_vectors(docs(rows)) == pytest.approx(want, abs=1e-6)


def test_pooling_in_pieces(monkeypatch):
    texts = pa.array(["a b c a a", "", "x " * 50, "d"])
    vectors = np.random.default_rng(1).normal(size=(ops.BUCKETS, ops.SIZE)).astype(np.float32)
    whole = ops.pool(texts, vectors)
    monkeypatch.setattr(ops, "_UNITS", 7)
    assert ops.pool(texts, vectors) == pytest.approx(whole, abs=1e-5)
    found, n = ops.units(texts)
    assert n.tolist() == [6, 0, 99, 1] and len(found) == 106


def test_nothing_to_learn(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in ops.score_documents(docs(AWKWARD), none).collect()} == {0.5}
    assert ops.score_documents(docs(AWKWARD).where("false"), none).count() == 0
