"""Removal of repeated byte strings with sharded suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document with a smaller key, or
further left in its own. Equal strings must meet, and nothing else should move:

1. *Anchors.* Every window of 100 bytes chooses one 32-byte gram in it, the one with the least hash, leftmost among
   equals. Equal windows choose equal grams at equal offsets, so only occurrences of one gram need comparing. Windows
   that choose the same occurrence are neighbours; together they are its context, at most 168 bytes.
2. *Copies.* Occurrences meet by gram hash. Of equal contexts all but the first are covered as a whole; a map task
   settles those it sees twice itself, so a very common passage reaches the shuffle once per batch. What is left are
   contexts that share the gram and differ, the edges of shared passages.
3. *Suffix arrays.* The bytes of those contexts are fetched and put into shards, whole gram groups to a shard.
   Each shard is sorted by induced sorting; permuted common prefixes of 100 or more chain equal windows, and all but
   the first window of a chain are covered. A group larger than a shard is cut; its windows that are first in their
   shard are settled by a second, hashed comparison across shards.
4. *Cut.* Covered ranges are merged per document and cut out.

The order of documents is ``doc_id``. Defined cases: null is the empty text, which loses nothing; a null ``doc_id``
stands before all others; rows with equal ids are ordered by a digest of their text, equal rows by their position in
the input; an empty table gives no rows; a text of any length is read whole by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, map_arrow, materialize
from echoloom.llm.ordering import running_totals
from echoloom.llm.suffix_array import END, FIRST, SEPARATOR, permuted_common_prefixes, suffix_array

WINDOW = 100
GRAM = 32
# Bytes of context text in one suffix array.
SHARD_BYTES = 1 << 20

_SPAN = WINDOW - GRAM + 1
_POSITION_BITS = 31
# One odd number, and one 64-bit code per byte value, both from a fixed generator.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CODES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each position, by doubling; the last positions are not defined."""
    h, power, width = _CODES[raw], _BASE, 1
    with np.errstate(over="ignore"):
        while width < GRAM:
            new = h * power
            new[:-width] += h[width:]
            h, power, width = new, power * power, 2 * width
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each position, by doubling; the last positions are not defined."""
    low, have = values, 1
    while 2 * have <= width:
        new = low.copy()
        np.minimum(low[:-have], low[have:], out=new[:-have])
        low, have = new, 2 * have
    if have < width:
        rest = width - have
        new = low.copy()
        np.minimum(low[:-rest], low[rest:], out=new[:-rest])
        low = new
    return low


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, last window) of each chosen gram of texts that stand one after the other in ``raw``.

    ``starts`` and ``ends`` delimit the texts; windows that leave a text do not count.
    """
    room = ends - starts - WINDOW + 1
    starts, room = starts[room > 0], room[room > 0]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = gram_hashes(raw)
    # The order of grams depends on their hash alone, then on the position: not on where the batch begins.
    low = np.uint64(_POSITION_BITS)
    packed = (hashes >> low << low) | np.arange(len(raw), dtype=np.uint64)
    chosen = (window_minima(packed, _SPAN) & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    # Windows of all texts, as runs of positions.
    total = np.cumsum(room)
    windows = np.repeat(starts - (total - room), room) + np.arange(total[-1])
    picked = chosen[windows]
    first = np.concatenate([[True], (picked[1:] != picked[:-1]) | (windows[1:] != windows[:-1] + 1)])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(windows)) - 1
    return hashes[picked[at]], windows[at], windows[last]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64, copy=False).view(np.int64))


def _text_bytes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch, and their ends."""
    texts = pc.fill_null(column(batch, "text"), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chosen gram: gram hash, context hash, document, and ``place``: first window, span and whether it is settled.

    Settled rows have an equal context earlier in the batch; they only pass through, dealt by a hash of their own.
    """
    for batch in batches:
        raw, ends = _text_bytes(batch)
        starts = np.concatenate([[0], ends[:-1]])
        gram, first, last = anchors(raw, starts, ends)
        if not len(gram):
            continue
        data = memoryview(raw.tobytes())
        digest = xxhash.xxh3_64_intdigest
        context = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), (last + WINDOW).tolist())),
                              np.uint64, len(first))
        doc = np.searchsorted(ends, first, side="right")
        key = column(batch, "key").to_numpy()[doc]
        order = np.lexsort((first - starts[doc], key, context, gram))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (gram[order[1:]] == gram[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
        place = (first - starts[doc]) << 8 | (last - first) << 1 | again
        gram = np.where(again, context ^ (place.astype(np.uint64) * _BASE), gram)
        yield pa.RecordBatch.from_arrays([_signed(gram), _signed(context), pa.array(key), pa.array(place)],
                                         ["gram", "context", "key", "place"])


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram, context, key and place: covered ranges, and the first row of each of several contexts.

    A row with ``gram`` null is a covered range from ``low`` to ``high``; others are contexts to compare.
    """
    last_gram = last_context = None
    waiting = None  # the first row of a gram group, until a second context turns up
    for batch in batches:
        gram, context, key, place = (column(batch, n).to_numpy() for n in ("gram", "context", "key", "place"))
        if not len(gram):
            continue
        settled = (place & 1).astype(bool)
        low = place >> 8
        high = low + ((place >> 1) & 127) + WINDOW
        open_ = np.flatnonzero(~settled)
        g, c = gram[open_], context[open_]
        same_gram = np.concatenate([[bool(len(g)) and last_gram is not None and g[0] == last_gram], g[1:] == g[:-1]])[:len(g)]
        same = same_gram & np.concatenate([[bool(len(c)) and last_context is not None and c[0] == last_context],
                                           c[1:] == c[:-1]])[:len(c)]
        covered = np.sort(np.concatenate([np.flatnonzero(settled), open_[same]]))
        heads = open_[~same]
        rows = [pa.RecordBatch.from_arrays(
            [pa.nulls(len(covered), pa.int64()), pa.array(key[covered]), pa.array(low[covered]),
             pa.array(high[covered])], ["gram", "key", "low", "high"])]
        if len(heads):
            # A head counts if its gram group has another head, before or after it.
            follows = same_gram[~same]
            followed = np.append(follows[1:], False)
            wanted = heads[follows | followed]
            if follows[0] and waiting is not None:
                rows.append(waiting)
                waiting = None
            if not follows[0]:
                waiting = None
            end = heads[-1:]
            if not follows[-1]:
                waiting = _context_row(gram, key, low, high, end)
            elif not (follows[0] and len(heads) == 1):
                waiting = None
            rows.append(_context_row(gram, key, low, high, wanted))
        if len(g):
            last_gram, last_context = g[-1], c[-1]
        yield from (r for r in rows if r.num_rows)


def _context_row(gram, key, low, high, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(gram[at]), pa.array(key[at]), pa.array(low[at]), pa.array(high[at])],
                                      ["gram", "key", "low", "high"])


def _merge(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Covered windows as ranges: overlapping or adjacent ones of a document become one."""
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] > high[:-1])])
    at = np.flatnonzero(first)
    return key[at], low[at], high[np.append(at[1:], len(key)) - 1]


def repeated_windows(contexts: list[bytes], key: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, offset, first) of every window in a shard of contexts; ``first`` tells whether no equal one is earlier.

    The contexts are one text with separators; equal windows are neighbours in its suffix array.
    """
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    raw = np.frombuffer(b"\0".join([*contexts, b""]), np.uint8).astype(np.int64) + FIRST
    ends = np.cumsum(sizes + 1) - 1
    raw[ends] = SEPARATOR
    text = np.append(raw, END)
    array = suffix_array(text)
    shared = permuted_common_prefixes(text, array)
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    begins = ends - sizes
    chained = shared[array] >= WINDOW
    place = array[array < len(raw)]
    chained = chained[array < len(raw)]
    inside = raw[place] != SEPARATOR
    inside &= ends[owner[place]] - place >= WINDOW
    place, chained = place[inside], chained[inside]
    chain = np.cumsum(~chained)
    context, offset = owner[place], place - begins[owner[place]]
    order = np.lexsort((low[context] + offset, key[context], chain))
    first = np.ones(len(order), bool)
    first[1:] = chain[order[1:]] != chain[order[:-1]]
    return context[order], offset[order], first


def _shard(rows: dict[str, list], whole: bool) -> Iterator[pa.RecordBatch]:
    """Covered ranges of a shard; of a cut group also its first windows, to be compared with other shards."""
    key, low = np.array(rows["key"], np.int64), np.array(rows["low"], np.int64)
    context, offset, first = repeated_windows(rows["bytes"], key, low)
    at = low[context] + offset
    covered = ~first
    k, a, b = _merge(key[context[covered]], at[covered], at[covered] + WINDOW) if covered.any() else ([], [], [])
    none = pa.nulls(len(k), pa.binary())
    yield pa.RecordBatch.from_arrays([none, pa.array(k, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                     ["window", "key", "low", "high"])
    if not whole:
        i = np.flatnonzero(first)
        windows = [xxhash.xxh3_128_digest(rows["bytes"][c][o:o + WINDOW])
                   for c, o in zip(context[i].tolist(), offset[i].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(key[context[i]]), pa.array(at[i]),
                                          pa.array(at[i] + WINDOW)], ["window", "key", "low", "high"])


def _shards(limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {"key": [], "low": [], "bytes": []}
        size, begin, gram, cut = 0, 0, None, False

        def take(n):
            head = {c: v[:n] for c, v in rows.items()}
            for v in rows.values():
                del v[:n]
            return head

        for batch in batches:
            for g, key, low, data in zip(*(column(batch, n).to_pylist() for n in ("gram", "key", "low", "bytes"))):
                if g != gram:
                    if cut:
                        # The end of a cut group is a shard of its own.
                        yield from _shard(take(len(rows["key"])), whole=False)
                        size, cut = 0, False
                    elif size > limit // 2:
                        yield from _shard(take(len(rows["key"])), whole=True)
                        size = 0
                    gram, begin = g, len(rows["key"])
                elif size >= limit:
                    if begin and not cut:
                        yield from _shard(take(begin), whole=True)
                    yield from _shard(take(len(rows["key"])), whole=False)
                    size, begin, cut = 0, 0, True
                rows["key"].append(key)
                rows["low"].append(low)
                rows["bytes"].append(data)
                size += len(data) + 1
        if rows["key"]:
            yield from _shard(rows, whole=not cut)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """key, doc_id and text; keys are unique and in the order of the documents.

    The key is ``doc_id`` itself unless ids repeat or are missing, which a count over the ids alone tells.
    """
    rows = doc_rows(docs)
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.withColumn("key", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return running_totals(rows, order, {"key": None}, "keyed")[0]


def covered_ranges(keyed: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Ranges ``low`` to ``high`` of bytes to remove per ``key``; ranges of a key may overlap."""
    spark = keyed.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = map_arrow(keyed.select("key", "text"), _anchor_rows, "gram long, context long, key long, place long")
    dealt = rows.repartition(tasks, "gram").sortWithinPartitions("gram", "context", "key", "place")
    found = materialize(map_arrow(dealt, _settle, "gram long, key long, low long, high long"), "anchors")
    ranges = found.where("gram is null").select("key", "low", "high")

    # Per document one row of contexts, so its text is joined once; at most a few per hundred bytes of text.
    wanted = found.where("gram is not null").groupBy("key").agg(
        F.collect_list(F.struct("gram", "low", "high")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            for key, text, wanted in zip(*(column(batch, n).to_pylist() for n in ("key", "text", "wanted"))):
                raw = text.encode("utf-8", "surrogatepass")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["gram"] for w in wanted]), pa.array([key] * len(wanted)),
                     pa.array([w["low"] for w in wanted]), pa.array([raw[w["low"]:w["high"]] for w in wanted])],
                    ["gram", "key", "low", "bytes"])

    edges = map_arrow(keyed.select("key", "text").join(wanted, "key"), fetch,
                      "gram long, key long, low long, bytes binary")
    sorted_ = edges.repartition(tasks, "gram").sortWithinPartitions("gram", "key", "low")
    settled = materialize(map_arrow(sorted_, _shards(shard_bytes), "window binary, key long, low long, high long"),
                          "suffixes")
    ranges = ranges.unionByName(settled.where("window is null").select("key", "low", "high"))
    across = settled.where("window is not null")
    if not across.isEmpty():
        least = across.groupBy("window").agg(F.min(F.struct("key", "low")).alias("least"))
        later = across.join(least, "window").where(F.struct("key", "low") != F.col("least"))
        ranges = ranges.unionByName(later.select("key", "low", "high"))
    return ranges


def cut(text: str | None, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, removed runs) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for low, high in sorted(ranges):
        if low > end:
            runs += 1
            kept.append(raw[at:low])
            removed += high - low
            end = at = high
        elif high > end:
            removed += high - end
            end = at = high
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the remaining bytes, per row of ``docs``."""
    keyed = _keyed(docs)
    ranges = covered_ranges(keyed, shard_bytes).groupBy("key").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(column(batch, "text").to_pylist(), column(batch, "ranges").to_pylist()):
                kept, removed, runs = cut(text, [(r["low"], r["high"]) for r in found or ()])
                rows.append((len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3]),
                 pa.array(columns[3], pa.string())], names)

    return map_arrow(keyed.join(ranges, "key", "left").select("doc_id", "text", "ranges"), run,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
