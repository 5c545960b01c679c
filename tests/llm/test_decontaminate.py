import random

import numpy as np
import pytest

from echoloom.llm import decontaminate as ops
from tests.llm.conftest import AWKWARD


def edits_within(piece, text):
    """Least edits between the piece and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(piece, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def held(piece, body):
    """Short items stand in a text exactly, as whole words; other pieces within their edits."""
    if piece[:1] == piece[-1:] == b" ":
        return piece in b" " + body + b" "
    return edits_within(piece, b" " + body + b" ") <= ops.budget(len(piece))


def prose(rng, n):
    return " ".join("".join(rng.choice(["tion", "er", "an", "é", "st", "he"]) for _ in range(rng.randrange(1, 4)))
                    for _ in range(n))


def damage(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        chars[at:at + 1] = rng.choice([[], ["x"], [chars[at], "y"]])
    return "".join(chars)


def tables(spark, docs, rng, n=60):
    items = [(i, prose(rng, rng.randrange(8, 40))) for i in range(12)] + [(50, None), (51, ""), (None, "x"), (52, "tiny")]
    rows = list(AWKWARD)
    for i in range(n):
        inner = rng.choice([i for i in items[:12]])[1]
        inner = rng.choice([inner.upper(), damage(rng, inner, rng.randrange(30)), inner.replace(" ", ",\n"), ""])
        rows.append((100 + i, f"{prose(rng, rng.randrange(20))} {inner} {prose(rng, rng.randrange(20))}"))
    return spark.createDataFrame(items, "item_id long, text string"), docs(rows), items, rows


@pytest.mark.parametrize("index_bytes", [1 << 20, 300])
def test_leaks_equal_brute_force(spark, docs, index_bytes):
    bench, table, items, rows = tables(spark, docs, random.Random(3), 24)
    want = set()
    for d, t in rows:
        body = ops.clean(t).tobytes()
        for i, text in items:
            if any(held(p, body) for p in ops.pieces_of(text)):
                want.add((d, i))
    got = [(r.doc_id, r.item_id) for r in ops.find_leaks(table, bench, index_bytes).collect()]
    assert set(got) == want and len(got) == len(want) > 5
    kept = ops.keep_unleaked(table, bench, index_bytes)
    assert kept.columns == table.columns
    leaked = {d for d, _ in want}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in rows if d not in leaked), key=str)


@pytest.mark.parametrize("index_bytes", [1 << 20, 10])
def test_short_items_and_items_without_an_id(spark, docs, index_bytes):
    items = [(1, "Two words"), (2, "a 12-byte one"), (3, "x"), (None, "Which river, then?"), (None, "another of these"),
             (4, "word " * 400), (5, "thirty-nine bytes of text, not a byte more")]
    rows = [(1, "here two, WORDS stand"), (2, "two wordsmiths"), (3, "A 12 byte one."), (4, "x-ray"), (5, "axe"),
            (6, "which river then"), (7, "which rivers then"), (8, "another of these"), (9, "word " * 399 + "words word"),
            (10, "thirty nine bytes of text not a byte more"), (11, None), (None, "X")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in ops.find_leaks(docs(rows), bench, index_bytes).collect()}
    assert got == {(1, 1), (3, 2), (4, 3), (None, 3), (6, None), (8, None), (9, 4), (10, 5)}
    assert {r.doc_id for r in ops.keep_unleaked(docs(rows), bench, index_bytes).collect()} == {2, 5, 7, 11}


def test_lemma_holds():
    """Stretches within the budget always share enough q-grams in one band."""
    rng = random.Random(5)
    for _ in range(100):
        piece = ops.pieces_of(prose(rng, 40))[0]
        text = damage(rng, piece.decode("utf-8", "replace"), rng.randrange(ops.budget(len(piece)) + 1))
        raw = ops.clean(prose(rng, 5) + " " + text + " " + prose(rng, 5))
        if edits_within(piece, raw.tobytes()) <= ops.budget(len(piece)):
            found, *_ = ops.Index([(1, piece)]).search([raw])
            assert len(found)


def test_no_match_across_documents():
    piece = ops.pieces_of(prose(random.Random(2), 40))[0]
    half = np.frombuffer(piece, np.uint8)
    index = ops.Index([(1, piece)])
    assert not len(index.search([half[:52], half[52:]])[0])
    assert index.search([half[:52], half])[0].tolist()[0] == 1


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "x" * 100)], "item_id long, text string")
    table = docs([(1, "y")])
    assert ops.find_leaks(table.where("false"), bench).count() == 0
    assert ops.find_leaks(table, bench.where("false")).count() == 0
    assert ops.keep_unleaked(table, bench.where("false")).count() == 1
