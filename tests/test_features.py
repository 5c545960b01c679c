"""Model inputs against a loop over questions, windows and tokens."""

import random
import re
import uuid

import pytest

from echoloom.operators import features as ops

SPECIAL = ops.Special(101, 102, 0)


def _tokenizer():
    """Pieces of one to three characters by the word's first letter; some words have no token."""
    def run(words):
        out = []
        for w in words:
            size = 1 + ord(w[0]) % 3
            pieces = range(0, len(w), size) if w != "~" else ()
            out.append([(1000 + ord(w[i]) % 500, len(w[i:i + size])) for i in pieces])
        return out

    return run  # local, so that workers get it by value


tokenizer = _tokenizer()


def brute(question, context, answer, start, length, stride, longest):
    def tokens(text):
        found, at = [], 0
        for word in (text or "").split():
            at = text.index(word, at)
            place = at
            for i, n in tokenizer([word])[0]:
                found.append((i, place, place + n))
                place += n
            at += len(word)
        return found

    query, doc = [t[0] for t in tokens(question)][:longest], tokens(context)
    room = length - 3 - len(query)
    first = last = None
    if answer and start is not None:
        first = sum(e <= start for _, _, e in doc)
        last = sum(s <= start + len(answer) - 1 for _, s, _ in doc) - 1
    rows, begin = [], 0
    while begin < len(doc):
        window = doc[begin:begin + room]
        ids = [101, *query, 102, *(t[0] for t in window), 102]
        types = [0] * (len(query) + 2) + [1] * (len(window) + 1)
        mask = [0] + [1] * (len(query) + 1) + [0] * len(window) + [1]
        fill = length - len(ids)
        inside = first is not None and first >= begin and last < begin + len(window)
        offset = len(query) + 2 - begin
        rows.append((len(rows), ids + [0] * fill, [1] * len(ids) + [0] * fill, types + [0] * fill, 0, mask + [1] * fill,
                     first is None, first + offset if inside else 0, last + offset if inside else 0,
                     [t[1] for t in window], [t[2] for t in window]))
        if begin + len(window) == len(doc):
            break
        begin += min(len(window), stride)
    return rows


@pytest.mark.parametrize("length,stride,longest", [(24, 8, 5), (16, 3, 10), (64, 64, 8)])
def test_equals_a_loop(spark, length, stride, longest):
    rng = random.Random(length)
    words = ["river", "é", "Straße", "a", "bb", "~", "longest-word-of-all", "x.", "(1895)"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.randrange(n)))
    rows = [(i, text(14), text(60)) for i in range(60)] + [(90, None, "a b"), (91, "q", None), (92, "", ""), (93, "q", "~ ~")]
    full = []
    for i, q, c in rows:
        start = rng.randrange(len(c)) if c else None
        answer = None if start is None or i % 7 == 0 else c[start:start + rng.randrange(20)]
        full.append((i, q, c, answer, start, "kept"))
    df = spark.createDataFrame(full, "id int, question string, context string, answer string, answer_start long, k string")
    got = ops.model_inputs(df, tokenizer, SPECIAL, length, stride, longest)
    assert got.columns == ["id", "answer", "answer_start", "k", *ops.FEATURE]
    want = sorted((i, *row) for i, q, c, a, s, _ in full for row in brute(q, c, a, s, length, stride, longest))
    assert sorted((r.id, *(r[n] for n in ops.FEATURE)) for r in got.collect()) == want
    assert all(len(r.input_ids) == len(r.p_mask) == length for r in got.collect())


def test_a_tokenizer_of_a_public_vocabulary(spark):
    """Tokens of a byte-level vocabulary lead back to the characters of the answer."""
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.json")

    def pieces(words):
        found = tokenizers.Tokenizer.from_file(path).encode_batch(words, add_special_tokens=False)
        return [[(i, b - a) for i, (a, b) in zip(e.ids, e.offsets)] for e in found]

    context = "The committee met in Helsinki, unexpectedly, on the fourteenth of November."
    answer = "unexpectedly"
    df = spark.createDataFrame([("q", "When did they meet?", context, answer, context.index(answer))],
                               "id string, question string, context string, answer string, answer_start int")
    row = ops.model_inputs(df, pieces, SPECIAL, 64, 16, 10).first()
    offset = row.input_ids.index(102) + 1
    first, last = row.start_position - offset, row.end_position - offset
    assert context[row.token_starts[first]:row.token_ends[last]].startswith(answer) and not row.is_impossible


def test_texts_are_tokenized_in_pieces(spark, tmp_path):
    """However many rows a batch has, only words of a bounded piece of text are tokenized at once."""
    seen = str(tmp_path)

    def counted(words):
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(sum(map(len, words))))
        return [[(7, len(w))] for w in words]

    texts = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "i int, t string").coalesce(1)
    got = {r.i: r for r in df.select("i", ops.encode("t", counted).alias("c")).select("i", "c.*").collect()}
    assert len(got[900].ids) == 0 and len(got) == 201
    for i, t in enumerate(texts):
        at = [m.start() for m in re.finditer(r"\S+", t)]
        assert list(got[i].starts) == at and list(got[i].ends) == [a + len(w) for a, w in zip(at, t.split())]
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(sizes) > 4 and max(sizes) <= ops.PIECE_BYTES


def test_no_room_is_refused(spark):
    with pytest.raises(ValueError, match="no room"):
        ops.model_inputs(spark.range(1), tokenizer, SPECIAL, 10, 4, 7)
