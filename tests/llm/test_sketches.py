"""Sketches against exact sets, and neighbours against a sorted list."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from echoloom.llm import sketches as ops
from tests.llm.conftest import AWKWARD
from tests.llm.test_token_files import WORDS


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def brute(rows):
    """Rows of the query; distinct (doc_id, text) in descending order, each compared with the next, by exact sets."""
    def digest(text):
        return int(np.array([xxhash.xxh64_intdigest((text or "").encode(), 42)], np.uint64).view(np.int64)[0])

    copies = Counter((i, t or "") for i, t in rows)
    order = sorted(copies, key=lambda r: (r[0] is None, -(r[0] or 0), digest(r[1])))
    out = Counter()
    for at, (i, text) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own = shingles(text)
        out[i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(own, shingles(edited)), 9),
            round(likeness(own, shingles(after)), 9)] += copies[i, text]
    return out


def seen(rows):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)


def test_edits_equal_brute_force(docs):
    """With k above every text's shingles the estimates are exact."""
    rng = random.Random(9)
    rows = AWKWARD + [(100 + rng.randrange(400), prose(rng, rng.randrange(60))) for _ in range(300)]
    rows += [(900, rows[-1][1])] * 3 + [(-900, None), (950, "Éé  mixed CASE text é😀"), (951, "éÉ mixed case Text 😀")]
    got = ops.fingerprint_edits(docs(rows), 60_000).collect()
    assert seen(got) == brute(rows)


def test_many_equal_rows_spread_over_parts(spark, docs):
    rows = [(7, "the same row of a few words and more")] * 4000 + [(i, f"text {i} of other words") for i in range(-20, 20) if i != 7]
    dealt = ops.deal(docs(rows)).where("doc_id = 7 and not _guest").groupBy("_part").count().collect()
    assert len(dealt) >= 3 and sum(r["count"] for r in dealt) == 4000
    assert seen(ops.fingerprint_edits(docs(rows)).collect()) == brute(rows)


@pytest.mark.parametrize("rows", [[(1, "only one document here")], [(None, None)], [(None, "a b"), (3, None), (3, "")]])
def test_few_rows(docs, rows):
    assert seen(ops.fingerprint_edits(docs(rows)).collect()) == brute(rows)


def test_empty_table(docs):
    empty = docs([(1, "x")]).where("false")
    assert ops.fingerprint_edits(empty).count() == ops.fingerprint(empty).count() == 0


def test_estimates_are_near_the_truth():
    rng = random.Random(3)
    base = prose(rng, 3000).split()
    errors, contained = [], []
    for share in (0.05, 0.2, 0.5, 0.8, 0.95) * 8:
        cut = int(len(base) * share)
        a, b = " ".join(base), " ".join(base[:cut] + prose(rng, 3000 - cut).split())
        x, y = ops.sketch_texts([a, b])
        errors.append(ops.resemblance(x, y) - likeness(shingles(a), shingles(b)))
        contained.append(ops.containment(x, y) - len(shingles(a) & shingles(b)) / len(shingles(a)))
        assert abs(ops.distinct_shingles(x) / len(shingles(a)) - 1) < 0.35
        rng.shuffle(base)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05 and np.std(contained) < 0.1


def test_parts_merge_to_the_whole(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80), rng.choice(["a", "b", None])) for i in range(200)] + [(0, None, "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    prints = ops.fingerprint(table).join(table.select("doc_id", "source"), "doc_id")
    got = {r.key: (r.fingerprint, r.n_shingles) for r in ops.merge_by(prints, "source").collect()}
    for key in ("a", "b", None, "c"):
        hashes, _ = ops.shingle_hashes([t or "" for _, t, s in rows if s == key])
        whole = np.unique(hashes)[:ops.K]
        if key != "c":
            assert got[key] == (ops.to_text(whole), ops.distinct_shingles(whole))


def test_texts_round_trip_and_equal_texts_are_equal():
    a, b, c = ops.sketch_texts(["one two  three\nfour five six", "ONE two three four five six", ""])
    assert ops.to_text(a) == ops.to_text(b) and len(a) == 2
    assert (ops.from_text(ops.to_text(a)) == a).all() and ops.to_text(c) == "" and len(ops.from_text("")) == 0
    assert ops.resemblance(c, c) == 1 and ops.resemblance(a, c) == 0 and ops.containment(c, a) == 1
