import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

from echoloom.llm import byte_bpe as ops
from tests.llm.conftest import AWKWARD
from tests.llm.test_token_files import WORDS

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def brute(rows):
    enc = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ops.load_ranks(PATH), special_tokens={})
    out = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def test_ids_and_bytes_equal_the_library(docs, monkeypatch):
    monkeypatch.setattr(ops, "BLOCK_BYTES", 3000)
    rng = random.Random(2)
    blanks = [" ", "  ", "\n", "\n\n ", "\t", " ", "  ", "\r\n", ""]
    rows = AWKWARD + [(100 + i, "".join(x for _ in range(rng.randrange(40)) for x in (rng.choice(WORDS),
                                                                                     rng.choice(blanks))))
                      for i in range(300)]
    got = ops.encode_corpus(docs(rows), PATH, PATTERN).collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_every_character_is_split_alike():
    """Both pattern engines agree on what a letter, a number and a blank is, for every code point."""
    raw = {bytes([i]): i for i in range(256)}
    text = "".join(f"{chr(c)}\n" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for part in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]"):
        theirs = bytes(tiktoken.Encoding("t", pat_str=part, mergeable_ranks=raw, special_tokens={})
                       .encode_ordinary(text)).decode()
        assert "".join(ops.split(text, part)) == theirs, part


def test_empty_table(docs):
    assert ops.encode_corpus(docs([(1, "x")]).where("false"), PATH, PATTERN).count() == 0


def test_pack_round_trip():
    import numpy as np

    values = np.array([0, 1, 255, 256, 70000, 2 ** 32 - 1])
    assert (ops.unpack(ops.pack(values)) == values).all() and len(ops.unpack(ops.pack(values[:0]))) == 0
