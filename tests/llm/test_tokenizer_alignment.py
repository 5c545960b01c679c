"""Alignment against a loop over both libraries' plain ids."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest

from echoloom.llm import tokenizer_alignment as ops
from tests.llm.conftest import AWKWARD
from tests.llm.test_token_files import WORDS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\r\nb", "x\r y", "▁", "a ▁ b", " ", "\n", "  \n\n x", "a\n\n b  \n", "\xa0x　 y", "😀😀 🏳️‍🌈", "é ", "\x00 a\x1c b",
       "<s> <|endoftext|> <0x41>", "don't   stop\t\ttab", "ÀÉ ⁂ ⿕𠀀 ▁", "a" * 5000, "\r\r\n a\r", "x  " * 50, "ü  v"]


def tokens(text):
    a, b = ops.sides(A, B)
    if not text:
        return [], [], a, b
    left = a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    right = b.model.encode(text)
    raw = (" " + text).encode()
    if b"".join(a.table[i] for i in left) != raw or b"".join(b.table[i] for i in right) != raw:
        return [], [], a, b
    return left, right, a, b


def brute(rows):
    """Every column from plain ids: ends by running byte lengths, groups by common ends, counts over all texts."""
    per_row, count = [], Counter()
    for i, text in rows:
        left, right, a, b = tokens(text)
        a_end = {e: k for k, e in enumerate(accumulate(len(a.table[x]) for x in left))}
        b_end = {e: k for k, e in enumerate(accumulate(len(b.table[x]) for x in right))}
        links, groups, p, q = [], [], 0, 0
        for cut in sorted(a_end.keys() & b_end.keys()):
            r, s = a_end[cut] + 1, b_end[cut] + 1
            groups.append(",".join(map(str, left[p:r])) + "|" + ",".join(map(str, right[q:s])))
            links.append((left[r - 1], right[s - 1]))
            p, q = r, s
        count.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        per_row.append((i, len(left), len(right), len(groups), links, digest))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((i, n_a, n_b, n_groups, len(links), sum(count[x] == best[x[1]] for x in links),
                    sum(count[x] for x in links), digest) for i, n_a, n_b, n_groups, links, digest in per_row)


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(ops, "KNOWN_SEGMENTS", 150)
    rng = random.Random(4)
    blanks = [" ", "  ", "\n", "\n\n ", "\t", " ", "\r\n", "\xa0", ""]
    rows = AWKWARD + list(enumerate(ODD, 1000)) + [
        (100 + i, "".join(x for _ in range(rng.randrange(60)) for x in (rng.choice(WORDS), rng.choice(blanks))))
        for i in range(300)]
    got = ops.align_corpus(docs(rows), A, B).collect()
    assert Counter(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("text", ODD)
def test_segments_keep_the_text(text):
    parts = ops.segments(" " + text)
    assert "".join(parts) == " " + text
    assert all(p[0] in " \n\t" and not q[-1].isspace() for q, p in zip(parts, parts[1:]))


def test_spans_and_decoded_bytes_agree():
    """Ends that the libraries report for whole characters, ends from bytes for split ones."""
    a, b = ops.sides(A, B)
    text = " 😀 été ⁂ word 𠀀𠀀"
    for side in (a, b):
        ids, ends = side.tokens(text, text.encode())
        assert ends.tolist() == [*accumulate(len(side.table[i]) for i in ids)]
    assert any(len(b.table[i]) == 1 and i < 259 for i in b.tokens(text, text.encode())[0])


def test_a_model_with_cuts_inside_pieces_is_encoded_whole(monkeypatch):
    a, b = ops.sides(A, B)
    monkeypatch.setattr(b, "cuts_hold", False)
    text = "one two\nthree"
    whole, _ = ops.align_texts([text], ops.Lexicon(a, b))
    monkeypatch.setattr(b, "cuts_hold", True)
    assert ops.align_texts([text], ops.Lexicon(a, b))[0] == whole


def test_a_segment_that_does_not_come_back_spoils_no_other():
    a, b = ops.sides(A, B)
    texts = ["good text here", "a ▁ b", "more good text"]
    rows, links = ops.align_texts(texts, ops.Lexicon(a, b))
    assert rows[1] == (0, 0, 0, "") and rows[0][0] == 3 and rows[2][0] == 3 and len(links[1]) == 0


def test_empty_table(docs):
    assert ops.align_corpus(docs([(1, "x")]).where("false"), A, B).count() == 0
