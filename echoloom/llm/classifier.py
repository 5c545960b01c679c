"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. *Units.* Words are split at blanks; the letters of a word are a unit in lower case, each of its marks is one, and
   so are "all capitals" and "same word as before". Units fall into ``BUCKETS`` hash buckets.
2. *Random indexing.* Each bucket has a sparse random index vector from a fixed seed. The vector of a bucket is the
   sum of its neighbours' index vectors over all documents, within ``REACH`` units. Tasks add up their own sums; the
   shuffle carries ``BUCKETS * SIZE`` numbers a task, and as many in all reach the driver, whatever the corpus.
3. *Pooling.* A document is the mean and the spread of its units' vectors, and its length.
4. *Network.* Two layers, trained in numpy on at most ``MAX_LABELS`` labelled documents, those with the least hash
   of their id; a fifth of them is kept to fit the temperature that calibrates the probabilities.

Labels come only from documents whose ``crc32(doc_id as text) % 4`` is not 2. No score depends on labels, language,
source or id of its document.

Defined cases: null and empty texts pool to zeros and get the network's score for that; several labels of one id are
averaged, null labels ignored; without two classes of labels every score is the smoothed share of label 1; repeated
rows get equal rows; an empty table gives none; long texts are read whole, in pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, map_arrow, materialize
from echoloom.llm.token_files import gather

BUCKETS = 1 << 14
SIZE = 32
REACH = 2
SEED = 17
MAX_LABELS = 20_000
HIDDEN = 24
HELD_OUT = 2
THRESHOLD = 0.7
# Buckets in one row of sums; units handled at once.
_SLICE = 512
_UNITS = 1 << 16
_PAD, _CAPITALS, _AGAIN = 0, 1, 2
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def _bucket(unit: str) -> int:
    return 3 + zlib.crc32(unit.encode("utf-8", "surrogatepass")) % (BUCKETS - 3)


def index_vectors() -> np.ndarray:
    """A few random signs per bucket; the pad between documents has none."""
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((BUCKETS, SIZE), np.int8)
    for _ in range(4):
        vectors[np.arange(BUCKETS), rng.integers(0, SIZE, BUCKETS)] = rng.choice([-1, 1], BUCKETS)
    vectors[_PAD] = 0
    return vectors


def units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all units, units per text); each distinct word is taken apart once."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    flat, ends = [], []
    for word in coded.dictionary.to_pylist():
        if len(word) > 1 and word.isupper():
            flat.append(_CAPITALS)
        flat += map(_bucket, _PARTS.findall(word.lower()))
        ends.append(len(flat))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = parts.offsets.to_numpy().astype(np.int64)
    cuts = cuts - cuts[0]
    # An entry of its own for a word that stands twice in a row within a text.
    flat.append(_AGAIN)
    ends.append(len(flat))
    again = np.zeros(len(codes), bool)
    again[1:] = codes[1:] == codes[:-1]
    again[cuts[:-1][cuts[:-1] < len(codes)]] = False
    picks = np.empty(2 * len(codes), np.int64)
    picks[::2] = codes
    picks[1::2] = len(ends) - 1
    chosen = np.ones(2 * len(codes), bool)
    chosen[1::2] = again
    got, n = gather(np.array(flat, np.int64), np.array(ends, np.int64), picks[chosen])
    total = np.concatenate([[0], np.cumsum(n)])
    words = np.concatenate([[0], np.cumsum(chosen)])
    return got, np.diff(total[words[2 * cuts]])


def context_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors, by slices of buckets."""
    vectors = index_vectors()
    sums = np.zeros((BUCKETS, SIZE), np.int64)
    for batch in batches:
        texts = pc.fill_null(column(batch, "text"), "")
        found, n = units(texts)
        # REACH pads after each text keep neighbours apart.
        line = np.insert(found, np.repeat(np.cumsum(n), REACH), _PAD)
        line = np.concatenate([np.zeros(REACH, np.int64), line])
        for at in range(REACH, len(line), _UNITS):
            stop = min(at + _UNITS, len(line) - REACH)
            if stop <= at:
                break
            near = sum(vectors[line[at + d:stop + d]].astype(np.int16) for d in range(-REACH, REACH + 1) if d)
            order = np.argsort(line[at:stop], kind="stable")
            own = line[at:stop][order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            sums[own[first]] += np.add.reduceat(near[order].astype(np.int64), first, axis=0)
    sums[_PAD] = 0
    rows = [(i, sums[i:i + _SLICE].astype("<i8").tobytes()) for i in range(0, BUCKETS, _SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["slice", "sums"])


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice that this task sees, whatever the number of rows."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, sums in zip(column(batch, "slice").to_pylist(), column(batch, "sums").to_pylist()):
            total[at] = total.get(at, 0) + np.frombuffer(sums, "<i8")
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()])],
                                         ["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """One vector per bucket: its contexts over all documents, of length one, and its own index vector."""
    schema = "slice long, sums binary"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = map_arrow(doc_rows(docs).select("text"), context_sums, schema)
    # Tasks' sums meet in two steps, so that no task adds up those of all tasks.
    partial = map_arrow(slices.repartition(tasks, "slice", F.spark_partition_id() % 16), _add, schema)
    rows = map_arrow(partial.repartition(tasks, "slice"), _add, schema).collect()
    sums = np.zeros((BUCKETS, SIZE))
    for r in rows:
        sums[r.slice:r.slice + _SLICE] = np.frombuffer(r.sums, "<i8").reshape(-1, SIZE)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(norms, 1) + 0.5 * index_vectors()).astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the units' vectors and the length, per text."""
    found, n = units(texts)
    total = np.zeros((len(n), 2 * SIZE))
    ends = np.cumsum(n)
    for at in range(0, len(found), _UNITS):
        stop = min(at + _UNITS, len(found))
        first_text = int(np.searchsorted(ends, at, side="right"))
        last_text = int(np.searchsorted(ends, stop - 1, side="right"))
        texts_here = np.arange(first_text, last_text + 1)
        texts_here = texts_here[n[texts_here] > 0]
        own = vectors[found[at:stop]].astype(np.float64)
        starts = np.maximum(ends[texts_here] - n[texts_here], at) - at
        total[texts_here] += np.add.reduceat(np.hstack([own, own * own]), starts, axis=0)
    mean = total / np.maximum(n, 1)[:, None]
    spread = np.sqrt(np.maximum(mean[:, SIZE:] - mean[:, :SIZE] ** 2, 0))
    return np.hstack([mean[:, :SIZE], spread, np.log1p(n)[:, None] / 10]).astype(np.float32)


class Network:
    """Two layers with a sigmoid end and a temperature; a constant where there is nothing to learn from."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, rounds: int = 600):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(np.unique(y > 0.5)) < 2 else None
        if self.constant is not None:
            return
        rng = np.random.default_rng(SEED)
        held = calibrate if 1 < calibrate.sum() < len(y) - 1 else np.zeros(len(y), bool)
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z, t = (x[~held] - self.shift) / self.scale, y[~held]
        weights = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN),
                   rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, rounds + 1):
            hidden = np.tanh(z @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3][0]) - t) / len(t)
            back = np.outer(error, weights[2]) * (1 - hidden ** 2)
            slopes = [z.T @ back + 1e-4 * weights[0], back.sum(axis=0), hidden.T @ error + 1e-4 * weights[2],
                      np.array([error.sum()])]
            for w, g, m, v in zip(weights, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.weights, self.temperature = weights, 1.0
        if held.any():
            logits = self.logits(x[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            loss = [np.mean(np.logaddexp(0, logits / k) - y[held] * logits / k) for k in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) / self.scale @ self.weights[0] + self.weights[1])
        return hidden @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), float(self.constant))
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _pooled(data: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), "<f4").reshape(-1, 2 * SIZE + 1)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label must not be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT


def train(pooled: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Network:
    """A network from at most ``max_labels`` labelled rows that may be learned from."""
    given = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    given = given.where(F.col("y").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = pooled.join(given, "doc_id").select("doc_id", "pooled", "y", F.xxhash64("doc_id").alias("draw"))
    # Hashes are spread evenly, so a cut below the bound leaves about that many rows, and only those are sent.
    n = known.count()
    if n > max_labels:
        known = known.where(F.col("draw") < int(2 ** 64 * (0.95 * max_labels / n)) - 2 ** 63)
    rows = sorted(known.collect(), key=lambda r: (r.draw, r.doc_id, bytes(r.pooled)))[:max_labels]
    x = np.frombuffer(b"".join(bytes(r.pooled) for r in rows), "<f4").reshape(-1, 2 * SIZE + 1).astype(np.float64)
    return Network(x, np.array([r.y for r in rows]), np.array([r.draw % 5 == 0 for r in rows], bool))


def score_documents(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted, per row of ``docs``."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))  # BUCKETS * SIZE numbers

    def pool_rows(batches):
        for batch in batches:
            found = pool(pc.fill_null(column(batch, "text"), ""), vectors.value)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array([row.astype("<f4").tobytes() for row in found], pa.binary())],
                ["doc_id", "pooled"])

    pooled = materialize(map_arrow(doc_rows(docs), pool_rows, "doc_id long, pooled binary"), "pooled")
    network = train(pooled, labels, max_labels)

    def score_rows(batches):
        for batch in batches:
            scores = network.score(_pooled(column(batch, "pooled")).astype(np.float64))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = map_arrow(pooled, score_rows, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
