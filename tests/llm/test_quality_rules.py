import random
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import quality_rules as ops
from tests.llm.conftest import AWKWARD


def brute(text):
    text = text or ""
    words, at = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [at] if at else []
            at = ""
        else:
            at += c
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            sum(line in lines[:i] for i, line in enumerate(lines)), len(inside),
            n < 50 or 100 * len(inside) > 50 * n)


def prose(rng, n=120):
    words = [rng.choice("abcdefghij") + rng.choice(["tion", "er", "ing", "al", "o"]) + rng.choice("stuvwxyz")
             for _ in range(n)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(words)) + "."


def corpus(rng):
    rows = [(i, prose(rng)) for i in range(300)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(rng).split())) for i in range(20)]
    rows += [(2000 + i, " ".join(w.upper() + "!!" for w in prose(rng).split())) for i in range(20)]
    return rows


def test_counts_equal_brute_force(docs):
    rng = random.Random(3)
    rows = AWKWARD + corpus(rng)[:40] + [(90, "a b c\na b c\na b c d\n\n\n a b c"), (91, "a a a a a"), (92, "a a a")]
    got = ops.score_quality(docs(rows)).collect()
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r.doc_id, *(r[f] for f in ops.FEATURES[:5]), r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_junk_goes_and_clean_stays(docs):
    rows = corpus(random.Random(5))
    kept = {r.doc_id for r in ops.score_quality(docs(rows)).where("kept").collect()}
    assert kept == set(range(300))
    assert {r.doc_id for r in ops.keep_quality(docs(rows)).collect()} == kept


def test_a_clean_corpus_loses_nothing(docs):
    rng = random.Random(6)
    rows = [(i, prose(rng)) for i in range(40)]
    assert ops.score_quality(docs(rows)).where("kept").count() == 40


def test_keep_keeps_columns_and_stands_empty_tables(docs):
    empty = docs([(1, "x")]).where("false")
    assert ops.score_quality(empty).count() == 0
    assert ops.keep_quality(empty).columns == empty.columns and ops.keep_quality(empty).count() == 0


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(0)
    n, rules = 40000, len(ops.RULES)
    clean = rng.random(n) < 0.8
    bad = rng.random((n, rules)) < np.where(clean[:, None], 0.005, 0.75)
    codes, counts = np.unique(np.where(bad, ops.BAD, ops.GOOD) @ 3 ** np.arange(rules - 1, -1, -1),
                              return_counts=True)
    share, wrong = ops.fit(codes, counts)
    assert share[0] == pytest.approx(0.8, abs=0.03)
    assert wrong[0] == pytest.approx(np.full(rules, 0.005), abs=0.005)
    assert share[1:] @ wrong[1:] / share[1:].sum() == pytest.approx(np.full(rules, 0.75), abs=0.06)
