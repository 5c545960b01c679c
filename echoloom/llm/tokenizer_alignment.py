"""Alignment of two tokenizers over a corpus: groups between common cuts, links, and corpus-wide link counts.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model. Both are asked for the spans of their tokens:
character offsets from A, proto spans from B. A span's end is a coarse cut: it stands where the next token starts at or
after it. Tokens that split a character share its span (A), and byte-fallback tokens have empty ones (B): between two
coarse cuts their ends are found from the bytes that the ids decode to.

Neither tokenizer merges a non-blank with the space, tab or line end after it (checked against B's pieces, true of A's
pattern), so texts are cut there into *segments* that encode alike wherever they stand. A task encodes each distinct
segment once, many joined into one text, and cuts the tokens at the segments' ends. A text with a segment whose decoded
bytes differ from it is encoded whole instead.

1. Blocks of documents are encoded in tasks. A block's result is one packed row: per document the counts, the digest
   and the link sequence as numbers into the block's distinct id pairs; the pairs themselves leave as rows with counts.
2. Pairs are summed over the corpus (a map-side combine, then one shuffle), the highest count per B id is at most one
   row per B id.
3. Counts go back to the blocks that have the pair, and each document sums them over its links.

Defined cases: null and empty texts, and texts whose joined A or B bytes differ from space and text (for instance with
U+2581 in them), have no tokens: zeros and an empty digest; null ``doc_id`` values and repeated rows are rows like any
other; an empty table gives none; a text longer than a block is a block of its own, held by one task.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import blocks, doc_rows, map_arrow, materialize

# Bytes of text whose links are numbered together.
BLOCK_BYTES = 8 << 20
# Distinct segments that a task remembers; more start a new memory, which changes the work only.
KNOWN_SEGMENTS = 400_000
# Characters of segments joined into one text.
JOINED = 1 << 16
# Before these, after a non-blank, both tokenizers end a token.
_CUTS = " \n\t"
_RUNS = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
_ODD_BLANK = re.compile(r"[^\S \n\t]")
_ODD_RUNS = re.compile(r".+?(?<=\S)(?=[ \n\t])|.+", re.S)
# A segment of its own before joined segments: B puts its space before it.
_LEAD = " x"
# A pair as one number: A's id above this bit, B's below.
_HALF = 32


def segments(text: str) -> list[str]:
    """The text cut before every space, tab or line end that follows a non-blank."""
    return (_ODD_RUNS if _ODD_BLANK.search(text) else _RUNS).findall(text)


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes its bytes with."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """A tokenizer with the bytes of its tokens and the coarse spans it reports."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.digits = [str(i) for i in range(len(table))]

    def spans(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(ids, byte starts, byte ends) of the tokens of a text that begins with a space."""
        raise NotImplementedError

    def tokens(self, text: str, raw: bytes) -> tuple[list[int], np.ndarray] | None:
        """(ids, byte end of each token), or None where the decoded bytes are not the text's."""
        ids, starts, ends = self.spans(text)
        if b"".join([self.table[i] for i in ids]) != raw:
            return None
        at = np.array(ids, np.int64)
        refined = np.cumsum(self.lengths[at])
        coarse = np.append(starts[1:] >= ends[:-1], True) & (ends > starts)
        # Where a token stands alone in its span, both must agree; elsewhere the decoded bytes decide.
        if len(ids) and (refined[coarse] != ends[coarse]).any():
            return None
        return ids, np.where(coarse, ends, refined)


class ByteLevel(Side):
    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        table = [b""] * (max(vocabulary.values(), default=-1) + 1)
        byte = _byte_of_char()
        for token, i in vocabulary.items():
            table[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        super().__init__(table)

    def spans(self, text):
        found = self.tokenizer.encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        if not text.isascii():
            width = np.frombuffer(text.encode("utf-32-le"), "<u4")
            before = np.concatenate([[0], np.cumsum(1 + (width > 0x7f) + (width > 0x7ff) + (width > 0xffff))])
            offsets = before[offsets]
        return found.ids, offsets[:, 0], offsets[:, 1]


class Pieces(Side):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                          for i, n in enumerate(names)])
        blank = _CUTS + "▁"
        # No piece holds a cut after a non-blank: segments are then encoded alike alone and in a text.
        self.cuts_hold = not any(b in blank and not a.isspace() and a != "▁" for n in names for a, b in zip(n, n[1:]))

    def spans(self, text):
        pieces = self.model.encode(text[1:], return_type="proto").pieces
        ids = [p.id for p in pieces]
        # The model's own space before the text has no place in it: all spans move by one.
        ends = np.fromiter((p.end for p in pieces), np.int64, len(ids)) + 1
        starts = np.fromiter((p.begin for p in pieces), np.int64, len(ids)) + 1
        starts[:1] = 0
        return ids, starts, ends


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path), Pieces(b_path)


def align(text: str, a: Side, b: Side) -> tuple | None:
    """(A ids, A ends, B ids, B ends, common cuts) of a text that begins with a space, ends in bytes."""
    raw = text.encode()
    if (left := a.tokens(text, raw)) is None or (right := b.tokens(text, raw)) is None:
        return None
    return *left, *right, np.intersect1d(left[1], right[1], assume_unique=True)


class Aligned:
    """What is kept of a run of segments: their groups as text, token counts, and links as packed pairs."""

    def __init__(self, found: tuple, bounds: np.ndarray, a: Side, b: Side):
        a_ids, a_ends, b_ids, b_ends, cuts = found
        a_cut, b_cut = np.searchsorted(a_ends, cuts) + 1, np.searchsorted(b_ends, cuts) + 1
        a_words, b_words = [a.digits[i] for i in a_ids], [b.digits[i] for i in b_ids]
        ai, bi = a_cut.tolist(), b_cut.tolist()
        groups = [f"{','.join(a_words[p:q])}|{','.join(b_words[r:s])}"
                  for p, q, r, s in zip([0, *ai], ai, [0, *bi], bi)]
        pairs = (np.array(a_ids, np.int64)[a_cut - 1] << _HALF) | np.array(b_ids, np.int64)[b_cut - 1]
        # ``bounds`` are the byte ends of the segments, each a common cut.
        last = np.searchsorted(cuts, bounds) + 1
        self.ends = last
        self.pairs = pairs
        stops = last.tolist()
        self.groups = [";".join(groups[p:q]).encode() for p, q in zip([0, *stops], stops)]
        self.n_a = np.diff(a_cut[last - 1], prepend=0)
        self.n_b = np.diff(b_cut[last - 1], prepend=0)
        self.whole = len(last) > 0 and np.isin(bounds, cuts).all()


class Lexicon:
    """Distinct segments of a task with their alignment; ``ok`` is False where a segment's bytes do not come back."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.numbers: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_links = np.zeros(0, np.int64)
        self.ok = np.zeros(0, bool)
        self.starts = self.pairs = np.zeros(0, np.int64)

    def codes(self, parts: list[str]) -> list[int]:
        numbers = self.numbers
        return [numbers.setdefault(s, len(numbers)) for s in parts]

    def learn(self) -> None:
        """Encode the segments that were numbered since the last call."""
        new = list(self.numbers)[len(self.groups):] if len(self.numbers) > len(self.groups) else []
        texts: list[list[int]] = []
        size = JOINED
        for i, s in enumerate(new):
            if s[-1].isspace() or s[0] not in _CUTS:
                texts.append([i])
                size = JOINED
            elif size + len(s) > JOINED:
                texts.append([i])
                size = len(s)
            else:
                texts[-1].append(i)
                size += len(s)
        groups = [b""] * len(new)
        n_a, n_b, n_links, starts = (np.zeros(len(new), np.int64) for _ in range(4))
        ok = np.zeros(len(new), bool)
        pairs = [self.pairs]
        held = len(self.pairs)
        while texts:
            at = texts.pop()
            own = [new[i] for i in at]
            bounds = np.array([*accumulate((len(s.encode()) for s in own), initial=len(_LEAD))], np.int64)
            found = align(_LEAD + "".join(own), self.a, self.b)
            run = found and Aligned(found, bounds, self.a, self.b)
            if not run or not run.whole:
                if len(at) > 1:  # find the segments that do not come back
                    texts += [at[:len(at) // 2], at[len(at) // 2:]]
                continue
            for i, g in zip(at, run.groups[1:]):
                groups[i] = g
            n_a[at], n_b[at], ok[at] = run.n_a[1:], run.n_b[1:], True
            n_links[at], starts[at] = np.diff(run.ends), held + run.ends[:-1]
            pairs.append(run.pairs)
            held += len(run.pairs)
        self.groups += groups
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_links, self.ok = np.concatenate([self.n_links, n_links]), np.concatenate([self.ok, ok])
        self.starts, self.pairs = np.concatenate([self.starts, starts]), np.concatenate(pairs)

    def links_of(self, codes: np.ndarray) -> np.ndarray:
        """The links of a sequence of segments, one after the other."""
        n = self.n_links[codes]
        total = np.cumsum(n)
        return self.pairs[np.repeat(self.starts[codes] - (total - n), n) + np.arange(total[-1] if len(total) else 0)]


def align_texts(texts: Iterable[str], lexicon: Lexicon) -> tuple[list[tuple], list[np.ndarray]]:
    """Per text (n_a, n_b, n_groups, digest), and its links as packed pairs."""
    texts = list(texts)
    known = lexicon.b.cuts_hold
    coded = [np.array(lexicon.codes(segments(" " + t)) if t and known else [], np.int64) for t in texts]
    lexicon.learn()
    rows, links = [], []
    for text, codes in zip(texts, coded):
        if text and not (len(codes) and lexicon.ok[codes].all()):
            found = align(" " + text, lexicon.a, lexicon.b)
            run = found and Aligned(found, np.array([len(text.encode()) + 1]), lexicon.a, lexicon.b)
            if run and run.whole:
                rows.append((int(run.n_a[0]), int(run.n_b[0]), len(run.pairs), hashlib.sha256(run.groups[0]).hexdigest()))
                links.append(run.pairs)
                continue
            text = ""
        if not text:
            rows.append((0, 0, 0, ""))
            links.append(np.zeros(0, np.int64))
            continue
        own = lexicon.links_of(codes)
        digest = hashlib.sha256(b";".join([lexicon.groups[c] for c in codes.tolist()])).hexdigest()
        rows.append((int(lexicon.n_a[codes].sum()), int(lexicon.n_b[codes].sum()), len(own), digest))
        links.append(own)
    return rows, links


def _pack(numbers: np.ndarray) -> bytes:
    held = io.BytesIO()
    width = "<u2" if not len(numbers) or numbers.max() < 1 << 16 else "<u4"
    np.save(held, numbers.astype(width))
    return zstandard.compress(held.getvalue(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(zstandard.decompress(data))).astype(np.int64)


_BLOCK = ("block string, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, "
          "digests array<string>, payload binary")
_ENCODED = f"{_BLOCK}, a int, b int, idx int, n bigint"
_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema([("block", pa.string()), ("doc_ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_links", _LONGS),
                     ("digests", pa.list_(pa.string())), ("payload", pa.binary()), ("a", pa.int32()), ("b", pa.int32()),
                     ("idx", pa.int32()), ("n", pa.int64())])
_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")
_ROWS = 1 << 16


def encode_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One packed row per block of documents, and a row per distinct id pair of the block."""
    def rows(size, /, **columns):
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCHEMA],
            schema=_SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        a, b = sides(a_path, b_path)
        lexicon = Lexicon(a, b)
        for number, (ids, texts) in enumerate(blocks(batches, BLOCK_BYTES)):
            if len(lexicon.numbers) > KNOWN_SEGMENTS:
                lexicon = Lexicon(a, b)
            found, links = align_texts(texts, lexicon)
            block = f"{part}-{number}"
            pairs, at, n = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")  # frequent pairs get small numbers
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            n_a, n_b, n_links, digests = zip(*found)
            yield rows(1, block=[block], doc_ids=[ids], n_a=[n_a], n_b=[n_b], n_links=[n_links], digests=[digests],
                       payload=[_pack(rank[at])])
            for p in range(0, len(pairs), _ROWS):
                own = pairs[p:p + _ROWS]
                yield rows(len(own), block=[block] * len(own), a=own >> _HALF, b=own & ((1 << _HALF) - 1),
                           idx=rank[p:p + _ROWS], n=n[p:p + _ROWS])

    return map_arrow(doc_rows(docs), run, _ENCODED)


def link_counts(pairs: DataFrame) -> DataFrame:
    """Rows ``a, b, total, best``: an id pair's links in the corpus, and whether no pair of its B id has more."""
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("n").alias("total")), "link-counts")
    # At most one row for each id of B's vocabulary.
    highest = counts.groupBy("b").agg(F.max("total").alias("highest"))
    return counts.join(F.broadcast(highest), "b").select("a", "b", "total", (F.col("total") == F.col("highest"))
                                                         .alias("best"))


def _sum_block(block: pa.Table, found: pa.Table) -> pa.Table:
    at = found.column("idx").to_numpy()
    total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    total[at] = found.column("total").to_numpy()
    best[at] = found.column("best").to_numpy().astype(np.int64)
    own = block.to_pylist()[0]
    links = _unpack(own["payload"])
    cuts = np.concatenate([[0], np.cumsum(own["n_links"])]).astype(np.int64)

    def sums(values):
        return np.diff(np.concatenate([[0], np.cumsum(values[links])])[cuts])

    return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "n_a": pa.array(own["n_a"], pa.int64()),
                     "n_b": pa.array(own["n_b"], pa.int64()), "n_groups": pa.array(own["n_links"], pa.int64()),
                     "n_links": pa.array(own["n_links"], pa.int64()), "n_best": pa.array(sums(best), pa.int64()),
                     "count_sum": pa.array(sums(total), pa.int64()),
                     "groups_sha256": pa.array(own["digests"], pa.string())})


def align_corpus(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per row of ``docs``: tokens of both sides, groups, links, links that are their B id's best, and summed counts."""
    encoded = materialize(encode_blocks(docs, a_path, b_path), "aligned")
    pairs = encoded.where("a is not null").select("block", "a", "b", "idx", "n")
    packed = encoded.where("a is null").select(*(c.split()[0] for c in _BLOCK.split(", ")))
    found = pairs.drop("n").join(link_counts(pairs), ["a", "b"]).select(
        F.col("block").alias("home"), "idx", "total", "best")
    return packed.groupBy("block").cogroup(found.groupBy("home")).applyInArrow(_sum_block, _RESULT)
