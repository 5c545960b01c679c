"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``K`` smallest distinct hashes of a text's five-word shingles (a text of fewer words is one shingle,
a text without words none). Sketches of parts merge into the sketch of the whole, and two sketches estimate

* resemblance: of the ``K`` smallest hashes of both together, the share that both have;
* containment: of one side's hashes below the point up to which both are complete, the share the other has;
* the number of distinct shingles: exact below ``K``, else from the position of the largest hash kept.

As text, a sketch is the base64 form of its 48-bit hashes in ascending order.

``fingerprint_edits`` compares every document with an edited copy and with the next document in descending order of
``doc_id``. Neighbours meet without one global window: distinct keys are ranked by bytes, which gives the first key of
each part; rows go to their part, and each part also gets the first row of the part after it.

Defined cases: null is the empty text; empty sketches are alike (1.0), an empty and another are not (0.0); null
``doc_id`` values come last; of one ``doc_id``, texts follow each other in the order of their 64-bit hashes; rows equal
in ``doc_id`` and text are one document, of which each row gets the result, and spread over parts if they are many; a
single document is its own next one; an empty table gives no rows; a long text is read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, map_arrow, texts_of
from echoloom.llm.ordering import running_totals

K = 128
SHINGLE = 5
BITS = 48
# Odd multipliers of the words of a shingle, by place: successive outputs of a 64-bit mixer.
_GOLDEN = 0x9E3779B97F4A7C15
# Keys whose sketches one task merges at a time.
MERGE_KEYS = 20_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)


def shingle_hashes(texts: Sequence[str], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(48-bit hashes of the word shingles of all texts, end of each text's hashes)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    digest = xxhash.xxh64_intdigest
    table = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    real = np.fromiter((len(w) > 0 for w in words), bool, len(words))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    kept = real[codes] if len(codes) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(kept)])[(offsets - offsets[0])[1:]]
    values = table[codes[kept]]
    counts = np.diff(ends, prepend=0)
    # Position p of the word array starts a shingle of min(shingle, words of its text) words.
    size = np.minimum(counts, shingle)
    starts = np.maximum(counts - shingle + 1, np.minimum(counts, 1))
    total = np.cumsum(starts)
    at = np.repeat((ends - counts) - (total - starts), starts) + np.arange(total[-1] if len(total) else 0)
    reach = np.repeat(size, starts)
    out = np.repeat(size.astype(np.uint64), starts)
    for place, multiplier in enumerate(_multipliers(shingle)):
        inside = reach > place
        out[inside] += values[at[inside] + place] * multiplier
    return _mix(out) >> np.uint64(64 - BITS), total


def sketch_texts(texts: Sequence[str], k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text, ascending."""
    hashes, ends = shingle_hashes(texts, shingle)
    return [np.unique(part)[:k] for part in np.split(hashes, ends[:-1])] if len(ends) else []


def merge(sketches: Iterable[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of texts taken together, from the sketches of each."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of both that both have."""
    both = np.concatenate([a, b])
    both.sort()
    double = both[1:] == both[:-1]
    if not len(both):
        return 1.0
    first = np.append(True, ~double)
    # The k smallest of the union are complete: each side holds its k smallest.
    last = both[first][:k][-1]
    return float((double & (both[1:] <= last)).sum() / min(int(first.sum()), k))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    reach = min((s[-1] for s in (a, b) if len(s) >= k), default=a[-1])
    inside = a[a <= reach]
    return float(np.isin(inside, b).mean()) if len(inside) else 0.0


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) * float(1 << BITS) / (float(a[k - 1]) + 1)


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:])).decode()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)
    return np.pad(raw, ((0, 0), (2, 0))).copy().view(">u8").ravel().astype(np.uint64)


# ---------------------------------------------------------------- tables

def fingerprint(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, n_shingles`` (estimated distinct shingles), row by row."""
    def run(batches):
        for batch in batches:
            found = sketch_texts(texts_of(batch), k, shingle)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(map(to_text, found), pa.string()),
                 pa.array([distinct_shingles(s, k) for s in found], pa.float64())],
                ["doc_id", "fingerprint", "n_shingles"])

    return map_arrow(doc_rows(docs), run, "doc_id long, fingerprint string, n_shingles double")


def merge_by(prints: DataFrame, key: str, k: int = K) -> DataFrame:
    """``key, fingerprint, n_shingles`` of all texts of a key (as text), from a table of fingerprints.

    Each task merges what it reads before the shuffle, so a key sends one sketch per task however many rows it has.
    """
    def run(batches):
        def rows():
            found = {name: merge([s], k) for name, s in held.items()}
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([to_text(s) for s in found.values()], pa.string()),
                 pa.array([distinct_shingles(s, k) for s in found.values()], pa.float64())],
                ["key", "fingerprint", "n_shingles"])

        held: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for name, text in zip(column(batch, "key").to_pylist(), column(batch, "fingerprint").to_pylist()):
                own = from_text(text or "")
                held[name] = merge([held[name], own], k) if name in held else own
            if len(held) > MERGE_KEYS and partial:
                yield rows()
                held.clear()
        if held:
            yield rows()

    schema = "key string, fingerprint string, n_shingles double"
    partial = True
    parts = map_arrow(prints.select(F.col(key).cast("string").alias("key"), "fingerprint"), run, schema)
    # At most one row per key and task is left; a key's rows are 1 kB each and merge as they come.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = False
    return map_arrow(parts.select("key", "fingerprint").repartition(tasks, "key"), run, schema)


# ---------------------------------------------------------------- neighbours

_ORDER = ("doc_id", "_digest")


def _order() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("_digest").asc()]


def _rank(doc_id: int | None, digest: int) -> tuple:
    """A key that sorts like ``_order``."""
    return (doc_id is None, -(doc_id or 0), digest)


def deal(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _digest, _part, _guest``: parts of near equal bytes in descending ``doc_id`` order.

    Each part ends with a guest, the first document of the part after it, and the last one with the first of all.
    The driver learns one key per part, and one for each document whose equal rows fill more than a part.
    """
    rows = doc_rows(docs).withColumn("_digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.groupBy(*_ORDER).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_size"))
    ranked, totals = running_totals(keys, _order(), {"_before": F.col("_size")}, "neighbours")
    width = max(1, -(-totals["_before"] // parts))
    placed = ranked.select(*_ORDER, "_before", F.expr(f"_before div {width}").alias("_first"),
                           F.expr(f"(_before + _size - 1) div {width}").alias("_last"))
    heads = sorted(((r[0], *r[1]) for r in placed.groupBy("_first").agg(
        F.min_by(F.struct(*_ORDER), "_before")).collect()), key=lambda r: r[0])
    wide = {(r[0], r[1]): (r[2], r[3]) for r in placed.where("_last > _first").select(
        *_ORDER, "_first", "_last").collect()}
    used = sorted({r[0] for r in heads} | {p for a, b in wide.values() for p in range(a, b + 1)})
    firsts = [r[0] for r in heads]
    ranks = [_rank(*r[1:]) for r in heads]

    @F.arrow_udf("int")
    def part_of(doc_id: pa.Array, digest: pa.Array, salt: pa.Array) -> pa.Array:
        from bisect import bisect_right

        out = []
        for key in zip(doc_id.to_pylist(), digest.to_pylist(), salt.to_pylist()):
            if spread := wide.get(key[:2]):
                out.append(spread[0] + key[2] % (spread[1] - spread[0] + 1))
            else:
                out.append(firsts[bisect_right(ranks, _rank(*key[:2])) - 1])
        return pa.array(out, pa.int32())

    # Which parts each head visits: those whose next later head it is; the last ones are visited by the first of all.
    visits: dict[tuple, list[int]] = {}
    for p in used:
        after = next((r for r in heads if r[0] > p), heads[0])
        visits.setdefault(tuple(after[1:]), []).append(p)
    guests = docs.sparkSession.createDataFrame(
        [(*key, p) for key, p in visits.items()], "_id long, _hash long, _parts array<int>")  # one entry per part
    # As text, so that a null id needs no condition of its own.
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    named = guests.select(F.coalesce(F.col("_id").cast("string"), F.lit("null")).alias("_name"), "_hash", "_parts")
    visitors = (
        rows.withColumn("_name", name).join(F.broadcast(named), ["_name"])
        .where(F.col("_digest") == F.col("_hash")).dropDuplicates(list(_ORDER))
        .select("doc_id", "text", "_digest", F.explode("_parts").alias("_part"), F.lit(True).alias("_guest"))
    )
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 31))
    return rows.select("doc_id", "text", "_digest", part_of("doc_id", "_digest", salt).alias("_part"),
                       F.lit(False).alias("_guest")).unionByName(visitors).repartition(parts, "_part")


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the beginning of the text after it."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, n_shingles double, contained_in_edited double")
_OUT_ROWS = 4096


class _Held:
    """A document that waits for the next one."""

    __slots__ = ("part", "doc_id", "digest", "text", "copies", "guest", "sketch")

    def __init__(self, part, doc_id, digest, text, guest):
        self.part, self.doc_id, self.digest, self.text, self.guest = part, doc_id, digest, text, guest
        self.copies, self.sketch = 1, None


def _results(run: list[_Held], k: int) -> Iterator[pa.RecordBatch]:
    """Results of all but the last of a run of documents; a part's last document is a guest."""
    pairs = [(a, b) for a, b in zip(run, run[1:]) if a.part == b.part and not a.guest]
    edited = [edit(a.text, b.text) for a, b in pairs]
    new = [d for d in run if d.sketch is None]
    found = sketch_texts([d.text for d in new] + edited, k)
    for d, s in zip(new, found):
        d.sketch = s
    rows = []
    for (a, b), text, other in zip(pairs, edited, found[len(new):]):
        row = (a.doc_id, len(a.text), hashlib.sha256(text.encode()).hexdigest(), to_text(a.sketch), to_text(other),
               resemblance(a.sketch, other, k), resemblance(a.sketch, b.sketch, k), distinct_shingles(a.sketch, k),
               containment(a.sketch, other, k))
        left = a.copies
        while left:
            step = min(left, _OUT_ROWS - len(rows))
            rows += [row] * step
            left -= step
            if len(rows) == _OUT_ROWS:
                yield _edit_batch(rows)
                rows = []
    if rows:
        yield _edit_batch(rows)


def _edit_batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _EDITS.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)],
                                      [n for n, _ in fields])


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Per row: its sketch, that of its edited text, and how alike both and its next document's are."""
    def run(batches):
        held: _Held | None = None
        for batch in batches:
            found = [held] if held else []
            for row in zip(*(column(batch, c).to_pylist() for c in ("_part", "doc_id", "_digest")), texts_of(batch),
                           column(batch, "_guest").to_pylist()):
                last = found[-1] if found else None
                if last and (last.part, last.doc_id, last.digest, last.guest) == (*row[:3], row[4]):
                    last.copies += 1
                else:
                    found.append(_Held(*row))
            yield from _results(found, k)
            held = found[-1] if found else None

    if docs.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], _EDITS)
    ordered = deal(docs).sortWithinPartitions("_part", "_guest", *_order())
    return map_arrow(ordered, run, _EDITS)
