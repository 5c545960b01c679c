import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from echoloom.llm import token_files as ops
from tests.llm.conftest import AWKWARD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("step", [0, 1, 3, 1000, 2 ** 40])
def test_elias_fano_round_trip(step):
    rng = np.random.default_rng(step % 97)
    values = np.cumsum(rng.integers(0, step + 1, 1500).astype(np.uint64), dtype=np.uint64)
    low, *parts = ops.ef_encode(values, int(values[-1]))
    data = b"".join(parts)
    coded = ops.EliasFano(lambda o, n: data[o:o + n], 0, len(values), low, len(parts[1]))
    assert coded.end == len(data)
    for a, b in [(0, 1500), (0, 1), (255, 257), (256, 512), (1499, 1500), (700, 1300), (5, 5)]:
        assert (coded.select(a, b) == values[a:b]).all()
    if step > 1000:
        return
    assert len(data) * 8 < 1500 * (4 + np.log2(step + 1)) + 400


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start, out = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


WORDS = ["Élan", "naïve,", "it's", "ΣΑΣ", "x" * 50, "été", "<|endoftext|>", "12345", "don't!", "\x1c", "ab\x85cd",
         "straße.", "ẞ", "İx", "日本語", "a:b", "?!", "the", "thing;", " ", "K", "a​b", "tion"]


def test_ids_equal_the_library(docs):
    rng = random.Random(1)
    rows = [r for r in AWKWARD if r[0] not in (None, 4)]
    rows += [(100 + i, rng.choice([" ", "\n", "  "]).join(rng.choices(WORDS, k=rng.randrange(40)))) for i in range(300)]
    got = ops.token_index(docs(rows), PATH).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(rows)


def test_blocks_and_ties(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = ops.write_tokens(docs(AWKWARD), folder, PATH)
    got = ops.read_tokens(manifest, folder, read_docs=2).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in AWKWARD), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert sorted(r.n_tokens for r in got) == sorted(b[2] for b in brute(AWKWARD))


def test_empty_table(docs):
    assert ops.token_index(docs([(1, "x")]).where("false"), PATH).count() == 0
