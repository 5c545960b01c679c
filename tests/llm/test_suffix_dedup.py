import hashlib
import random

import numpy as np
import pytest

from echoloom.llm import suffix_array as sa
from echoloom.llm import suffix_dedup as ops
from tests.llm.conftest import AWKWARD


def test_arrays_equal_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(200):
        letters = rng.choice([1, 2, 3, 250])
        text = [rng.choice([sa.SEPARATOR, *range(sa.FIRST, sa.FIRST + letters)]) for _ in range(rng.randrange(60))]
        text.append(sa.END)
        want = sorted(range(len(text)), key=lambda i: text[i:])
        array = sa.suffix_array(np.array(text))
        assert array.tolist() == want
        shared = sa.permuted_common_prefixes(np.array(text), array)
        for a, b in zip(want, want[1:]):
            n = 0
            while text[a + n] == text[b + n] and text[a + n] >= sa.FIRST:
                n += 1
            assert shared[b] == n


def brute(rows):
    """Rows in order; a window is covered if its bytes started anywhere earlier."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for a, b in zip(b"\0" + gone, gone) if b and not a)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n):
    words = ["tion", "thé", "of", "an", "er", "in"]
    prose = lambda k: " ".join(rng.choice(words) + rng.choice(words) + rng.choice(words) for _ in range(k))
    passages = [prose(rng.randrange(6, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice([prose(rng.randrange(1, 30)), rng.choice(passages),
                             rng.choice(passages)[rng.randrange(40):], "ab " * rng.randrange(60)])
                 for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(10 ** 6) * 1000 + i, rng.choice([" ", "\n"]).join(parts)))
    return rows + [(10 ** 12 + i, rows[i][1]) for i in range(0, n, 7)]


@pytest.mark.parametrize(("shard", "batch"), [(1 << 20, 4 << 20), (2000, 4000)])
def test_removed_bytes_equal_brute_force(docs, monkeypatch, shard, batch):
    import echoloom.llm.batches as batches

    monkeypatch.setattr(batches, "BATCH_BYTES", batch)
    rows = corpus(random.Random(shard), 150)
    got = ops.remove_repeats(docs(rows), shard).orderBy("doc_id").collect()
    want = brute(rows)
    assert [tuple(r) for r in got] == want
    assert sum(w[2] for w in want) > 10000


def test_awkward_rows(docs):
    rows = [r for r in AWKWARD if r[0] is not None] + [(20, "y" * 300), (20, "y" * 300), (None, "y" * 300)]
    got = ops.remove_repeats(docs(rows)).collect()
    ranked = sorted((tuple(r) for r in got), key=str)
    assert ranked == sorted(brute(rows), key=str)


def test_a_common_passage_over_many_documents(docs):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(rng.randrange(120))) + passage + "".join(
        rng.choice("qrstuv ") for _ in range(rng.randrange(120)))) for i in range(400)]
    got = ops.remove_repeats(docs(rows), 3000).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_empty_table(docs):
    assert ops.remove_repeats(docs([(1, "x")]).where("false")).count() == 0
