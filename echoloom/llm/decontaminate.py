"""Benchmark decontamination by the q-gram lemma.

Items are cut into overlapping pieces. A document holds a piece if some stretch of it is within the piece's edit
budget, a tenth of its length. By the q-gram lemma such a stretch shares at least ``m + 1 - q * (budget + 1)`` q-grams
with the piece, and its edits keep it within ``budget + 1`` neighbouring diagonals (document position less piece
position). So shared q-grams are counted per piece in bands of twice that width that overlap by half, every stretch
lies whole in one of them, bands below the bound are dropped, and the rest are aligned, within the band.

Texts are compared in lower case, with every run of blanks and ASCII marks as one blank, as UTF-8 bytes. Documents
stay where they are read: the index of the pieces goes to them, in parts of at most ``INDEX_BYTES``; a benchmark of
several parts is several passes over the documents.

An item shorter than ``MIN_BYTES`` after that cleaning has no edits to spare: it is found where it stands exactly, as
whole words.

Defined cases: a null or empty text holds nothing; an item that is null or empty after cleaning holds nothing to search
for; an item without an id is one with a null id; rows of one id are one item; repeated rows give repeated results;
empty tables give no rows; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, fresh, map_arrow, texts_of

Q = 8
EDIT_RATE = 0.1
# Length and step of the pieces of an item, in cleaned bytes; an item that is shorter is one piece.
PIECE, STEP = 100, 50
MIN_BYTES = 40
INDEX_BYTES = 8 << 20
# More than any budget, so that no alignment crosses from one document into the next.
_GAP = int(PIECE * 1.5 * EDIT_RATE) + Q
_TABLE_BITS = 22
_CLEAN = np.array([ord(" ") if b < 128 and not chr(b).isalnum() else b for b in range(256)], np.uint8)


def clean(text: str | None) -> np.ndarray:
    """Lower case, runs of blanks and marks as one blank, none at the ends; as bytes."""
    raw = _CLEAN[np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    raw = raw[keep]
    if len(raw) and raw[-1] == 32:
        raw = raw[:-1]
    return raw[1:] if len(raw) and raw[0] == 32 else raw


def pieces_of(text: str | None) -> list[bytes]:
    """Pieces to search for; one that begins and ends with a blank is to be found exactly."""
    raw = clean(text).tobytes()
    if len(raw) < MIN_BYTES:
        return [b" " + raw + b" "] if raw else []
    if len(raw) <= PIECE:
        return [raw]
    starts = [*range(0, len(raw) - PIECE, STEP), len(raw) - PIECE]
    return [raw[s:s + PIECE] for s in starts]


def budget(length: int) -> int:
    return int(length * EDIT_RATE)


def grams(raw: np.ndarray) -> np.ndarray:
    """The ``Q`` = 8 bytes from each position as one number; defined where 8 bytes follow."""
    v = raw.astype(np.uint64)
    for width in (1, 2, 4):
        new = v.copy()
        new[:-width] |= v[width:] << np.uint64(8 * width)
        v = new
    return v


def _slot(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)


class Index:
    """q-grams of pieces, sorted, with the pieces and places they occur at; ``item`` is a number, ``ids`` has its id."""

    def __init__(self, pieces: list[tuple[int | None, bytes]]):
        numbers: dict[int | None, int] = {}
        items = [numbers.setdefault(i, len(numbers)) for i, _ in pieces]
        self.ids = pa.array(list(numbers), pa.int64())
        # Pieces without a whole q-gram are looked up as runs of words.
        small = [len(p) < Q for _, p in pieces]
        self.words: dict[bytes, list[int]] = {}
        for (_, p), item, tiny in zip(pieces, items, small):
            if tiny:
                self.words.setdefault(p.strip(), []).append(item)
        self.runs = sorted({w.count(b" ") + 1 for w in self.words})
        pieces = [p for p, tiny in zip(pieces, small) if not tiny]
        self.items = np.array([i for i, tiny in zip(items, small) if not tiny], np.int64)
        self.pieces = [p for _, p in pieces]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        exact = np.array([p[:1] == p[-1:] == b" " and len(p) < MIN_BYTES + 2 for p in self.pieces], bool)
        self.budgets = np.where(exact, 0, (self.lengths * EDIT_RATE).astype(np.int64))
        values = [grams(np.frombuffer(p, np.uint8))[:len(p) - Q + 1] for p in self.pieces]
        flat = np.concatenate([np.zeros(0, np.uint64), *values])
        piece = np.repeat(np.arange(len(pieces)), [len(v) for v in values])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(v)) for v in values)])
        order = np.argsort(flat, kind="stable")
        self.values, first = np.unique(flat[order], return_index=True)
        self.begins = np.append(first, len(flat)).astype(np.int64)
        self.piece, self.place = piece[order], place[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[_slot(self.values)] = True

    def candidates(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, first diagonal) of bands of ``raw`` that share enough q-grams with a piece."""
        values = grams(raw)
        at = np.flatnonzero(self.table[_slot(values)])
        where = np.searchsorted(self.values, values[at])
        where[where == len(self.values)] = 0
        exact = self.values[where] == values[at] if len(self.values) else np.zeros(len(at), bool)
        at, where = at[exact], where[exact]
        n = self.begins[where + 1] - self.begins[where]
        total = np.cumsum(n)
        if not len(total):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        posting = np.repeat(self.begins[where] - (total - n), n) + np.arange(total[-1])
        piece = self.piece[posting]
        half = self.budgets[piece] + 1
        # Each diagonal lies in the upper half of one band and in the lower half of the next.
        diagonal = np.repeat(at, n) - self.place[posting] + PIECE
        band = diagonal // half
        span = len(raw) + 2 * PIECE + 2
        codes, counts = np.unique(np.concatenate([piece * span + band, piece * span + band - 1]), return_counts=True)
        found, bands = codes // span, codes % span
        bound = self.lengths[found] + 1 - Q * (self.budgets[found] + 1)
        enough = counts >= np.maximum(bound, 1)
        found, bands = found[enough], bands[enough]
        return found, bands * (self.budgets[found] + 1) - PIECE

    def align(self, raw: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least edits, diagonal of the end) of each piece within its band of ``raw``, both ends free."""
        width = 2 * (int(self.budgets[piece].max()) + 1)
        longest = int(self.lengths[piece].max())
        letters = np.zeros((len(piece), longest), np.uint8)
        for i, p in enumerate(piece.tolist()):
            letters[i, :self.lengths[p]] = np.frombuffer(self.pieces[p], np.uint8)
        padded = np.concatenate([np.zeros(PIECE + width, np.uint8), raw, np.zeros(longest + 2 * width, np.uint8)])
        begin = diagonal + PIECE + width
        steps = np.arange(width)
        own = 2 * (self.budgets[piece] + 1)
        outside = np.where(steps[None, :] < own[:, None], 0, 1 << 20)
        cost = outside.copy()
        final = np.full(cost.shape, 1 << 20)
        for row in range(longest):
            text = padded[begin[:, None] + row + steps]
            new = cost + (text != letters[:, row:row + 1])
            new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
            new = np.minimum.accumulate(new - steps, axis=1) + steps
            cost = np.maximum(new, outside)
            ended = self.lengths[piece] == row + 1
            final[ended] = cost[ended]
        best = final.argmin(axis=1)
        return final[np.arange(len(piece)), best], diagonal + best

    def _tiny(self, number: int, text: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        words = text.tobytes().split(b" ")
        starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        for n in self.runs:
            for i in range(len(words) - n + 1):
                for item in self.words.get(b" ".join(words[i:i + n]), ()):
                    yield number, item, starts[i], starts[i + n] - 1, 0

    def search(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(text, item, start, end, edits) of pieces found in cleaned texts."""
        # A blank on either side, so that words at the ends are whole words.
        gap = np.zeros(_GAP + 2, np.uint8)
        gap[[0, -1]] = 32
        raw = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
        begins = np.cumsum([len(gap), *(len(t) + len(gap) for t in texts)])
        piece, diagonal = self.candidates(raw)
        out = []
        for at in range(0, len(piece), 4096):
            p, d = piece[at:at + 4096], diagonal[at:at + 4096]
            edits, end = self.align(raw, p, d)
            good = edits <= self.budgets[p]
            p, end, edits = p[good], end[good], edits[good]
            stop = end + self.lengths[p]
            text = np.searchsorted(begins, np.maximum(end + self.lengths[p] // 2, 0), side="right") - 1
            start = np.maximum(end, begins[text])
            out.append((text, self.items[p], start - begins[text], stop - begins[text], edits))
        if self.runs and (tiny := [row for i, t in enumerate(texts) for row in self._tiny(i, t)]):
            out.append(tuple(np.array(c, np.int64) for c in zip(*tiny)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> list:
    """Broadcast indexes over all items, each of at most ``index_bytes`` of pieces, read part by part."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts, held, size = [], [], 0
    for row in rows.where("text is not null").orderBy("item_id").toLocalIterator():
        pieces = pieces_of(row.text)
        held += [(row.item_id, p) for p in pieces]
        size += sum(map(len, pieces))
        if size > index_bytes:
            parts.append(context.broadcast(Index(held)))
            held, size = [], 0
    if held or not parts:
        parts.append(context.broadcast(Index(held)))
    return parts


def find_leaks(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per document row and item found in it: pieces found, least edits, where the first one stands.

    ``start`` and ``stop`` are positions in the cleaned text.
    """
    names = ["doc_id", "item_id", "pieces", "edits", "start", "stop"]

    def passes(part):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                text, item, start, stop, edits = part.value.search([clean(t) for t in texts_of(batch)])
                if not len(text):
                    continue
                order = np.lexsort((start, item, text))
                text, item, start, stop, edits = (x[order] for x in (text, item, start, stop, edits))
                first = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
                spread = np.append(True, start[1:] > start[:-1] + STEP // 2)
                spread[first] = True
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(pa.array(text[first])), part.value.ids.take(pa.array(item[first])),
                     pa.array(np.add.reduceat(spread.astype(np.int64), first)),
                     pa.array(np.minimum.reduceat(edits, first)), pa.array(start[first]), pa.array(stop[first])], names)

        return map_arrow(doc_rows(docs), run, "doc_id long, item_id long, pieces long, edits long, start long, stop long")

    return reduce(DataFrame.unionByName, [passes(p) for p in indexes(benchmark, index_bytes)])


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark piece, all columns unchanged."""
    (text,) = fresh(docs, "text_to_search")
    names, out = docs.columns, docs
    for part in indexes(benchmark, index_bytes):
        def run(batches, part=part):
            for batch in batches:
                found = part.value.search([clean(t) for t in texts_of(batch, text)])[0]
                keep = np.ones(batch.num_rows, bool)
                keep[found] = False
                yield batch.select(names).filter(pa.array(keep))

        out = map_arrow(out.withColumn(text, F.col("text").cast("string")), run, docs.schema)
    return out
