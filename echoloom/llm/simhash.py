"""SimHash near copies, with candidates by the pigeonring principle.

A fingerprint has ``SEGMENTS`` segments in a ring. If two fingerprints differ in at most ``DISTANCE`` bits, then from
some segment on every run of *l* segments differs in at most ``l * DISTANCE / SEGMENTS`` bits: for five segments and
four bits, the first segment is equal, the first two differ in one bit at most, the first three in two, four in
three. So only fingerprints are compared that agree on a start segment and nearly agree on the two after it. They
meet at keys of these three segments with no bit or one bit of the last two turned over, 27 keys a start; the chain's
budgets are checked segment by segment before the whole distance.

Fingerprints, not documents, are compared, so copies cost one row. A key's fingerprints are compared in one task up
to ``KEY_ROWS``; beyond, they are cut into blocks and pairs of blocks are compared in tasks of their own, nothing left out. Links of a task leave it
as a spanning forest, never as all pairs.

Defined cases: null and empty texts have fingerprint zero, which links like any other; a null ``doc_id`` counts as
larger than any other and is the component's id only where there is no other; repeated rows share a component; an
empty table gives no rows; long texts are fingerprinted whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, fresh, map_arrow, materialize, texts_of
from echoloom.llm.components import connected
from echoloom.llm.shingle_links import in_blocks, meetings, profiles, shingle_components, within_parities

SHINGLE = 4
SEED = 42
DISTANCE = 4
# Bits of each segment, lowest first.
SEGMENTS = (13, 13, 13, 13, 12)
# Segments in a key.
CHAIN = 3
KEY_ROWS = 2048
# What parts words, as for ``bytes.split``.
BLANKS = " \t\n\r\x0b\x0c"

_OFFSETS = tuple(sum(SEGMENTS[:i]) for i in range(len(SEGMENTS)))
_MASKS = tuple(((1 << w) - 1) << o for w, o in zip(SEGMENTS, _OFFSETS))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the hashes of the text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    stop = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), stop)), np.uint64, n)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += bits[at:at + (1 << 16)].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _signed(values: Iterable[int]) -> np.ndarray:
    return np.fromiter(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint, as a signed integer of the same bits, per row of ``docs``."""
    def run(batches):
        for batch in batches:
            prints = _signed(fingerprint(t, shingle) for t in texts_of(batch))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(prints)], ["doc_id", "print"])

    return map_arrow(doc_rows(docs), run, "doc_id long, print long")


def plain_keys(prints: np.ndarray, start: int) -> np.ndarray:
    """The chain of three segments from ``start``, with the start above bit 40."""
    prints = prints.view(np.uint64)
    key = np.zeros(len(prints), np.uint64)
    for i in range(CHAIN):
        s = (start + i) % len(SEGMENTS)
        key = (key << np.uint64(SEGMENTS[s])) | ((prints & np.uint64(_MASKS[s])) >> np.uint64(_OFFSETS[s]))
    return (key | np.uint64(start << 40)).view(np.int64)


def chain_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) rows: each start's plain key, and the key with each bit of its later segments turned over."""
    keys = []
    for start in range(len(SEGMENTS)):
        plain = plain_keys(prints, start)
        free = sum(SEGMENTS[(start + i) % len(SEGMENTS)] for i in range(1, CHAIN))
        keys += [plain, *(plain ^ (1 << bit) for bit in range(free))]
    return np.concatenate(keys), np.tile(prints, len(keys))


def chain_holds(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences ``x`` keep every budget of the chain from ``start``, the whole ring included."""
    alive = np.ones(len(x), bool)
    total = np.zeros(len(x), np.int64)
    parts = np.stack([np.bitwise_count(x & np.uint64(m)) for m in _MASKS]).astype(np.int64)
    at = np.arange(len(x))
    for i in range(len(SEGMENTS)):
        total += parts[(start + i) % len(SEGMENTS), at]
        alive &= total <= (i + 1) * DISTANCE // len(SEGMENTS)
    return alive


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of every node to the smallest one it is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def links(runs: np.ndarray, keys: np.ndarray, prints: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within runs of rows; rows of one run on the same side above 0 are not compared.

    Two fingerprints that turned the same bit over agree before the turn too: their plain keys meet elsewhere.
    """
    start = keys >> 40
    turned = keys.copy()
    for s in range(len(SEGMENTS)):
        own = start == s
        turned[own] ^= plain_keys(np.ascontiguousarray(prints[own]), s)
    bits = prints.view(np.uint64)
    found_a, found_b, held, shift = [], [], 0, 1
    alive = np.arange(len(keys))
    while True:
        alive = alive[:np.searchsorted(alive, len(keys) - shift)]
        alive = alive[runs[alive] == runs[alive + shift]]
        if not len(alive):
            break
        other = alive + shift
        ask = (turned[alive] != turned[other]) | (turned[alive] == 0)
        ask &= (sides[alive] != sides[other]) | (sides[alive] == 0)
        i, j = alive[ask], other[ask]
        x = bits[i] ^ bits[j]
        in_chain = chain_holds(x, start[i])
        near = np.flatnonzero(in_chain)[np.bitwise_count(x[in_chain]) <= DISTANCE]
        found_a.append(prints[i[near]])
        found_b.append(prints[j[near]])
        held += len(near)
        if held > 1 << 20:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [a], [b], 0
        shift += 1
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _compare(batches: Iterable[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key, low and high block; rows of keys with more than ``limit`` rows come out as they are.

    ``side`` is 1 for rows of the low block and 2 for the high one, 0 where a block meets itself.
    """
    names = ("key", "low", "high", "side", "print")
    held = [np.zeros(0, np.int64)] * len(names)
    passing = None

    def out(hot, keys, a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), hot)), pa.array(keys), pa.array(a), pa.array(b)],
                                          ["hot", "key", "a", "b"])

    def done(rows):
        keys = rows[0]
        change = np.flatnonzero((np.diff(keys) != 0) | (np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
        runs = np.zeros(len(keys), np.int64)
        runs[change] = 1
        a, b = links(np.cumsum(runs), keys, rows[4], rows[3])
        return out(False, np.zeros(len(a), np.int64), a, b)

    for batch in batches:
        rows = [np.concatenate([h, column(batch, n).to_numpy().astype(np.int64)]) for h, n in zip(held, names)]
        if not len(rows[0]):
            continue
        if passing is not None:
            # The rest of a key that is already too large for one task.
            n = int(np.searchsorted(rows[0], passing, side="right"))
            yield out(True, rows[0][:n], rows[4][:n], rows[4][:n])
            rows = [r[n:] for r in rows]
            passing = passing if not len(rows[0]) else None
            if passing is not None:
                held = rows
                continue
        last = int(np.flatnonzero((rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1]))[0])
        held = [r[last:] for r in rows]
        rows = [r[:last] for r in rows]
        if limit and len(rows[0]):
            _, at, n = np.unique(rows[0], return_inverse=True, return_counts=True)
            large = n[at] > limit
            if large.any():
                yield out(True, rows[0][large], rows[4][large], rows[4][large])
                rows = [r[~large] for r in rows]
        if len(rows[0]):
            yield done(rows)
        if limit and len(held[0]) > limit:
            yield out(True, held[0], held[4], held[4])
            passing, held = int(held[0][0]), [r[:0] for r in held]
    if len(held[0]):
        yield done(held)


def near_links(prints: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Pairs ``a, b`` that connect all fingerprints at ``DISTANCE`` bits or less, for distinct values of ``print``."""
    spark = prints.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def expand(batches):
        for batch in batches:
            values = column(batch, "print").to_numpy()
            for at in range(0, len(values), 2048):
                keys, held = chain_keys(values[at:at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held)], ["key", "print"])

    schema = "hot boolean, key long, a long, b long"
    zero = F.lit(0).cast("bigint")
    keyed = map_arrow(prints.select("print"), expand, "key long, print long").repartition(tasks, "key")
    first = keyed.sortWithinPartitions("key").select("key", zero.alias("low"), zero.alias("high"), zero.alias("side"),
                                                     "print")
    found = materialize(map_arrow(first, lambda batches: _compare(batches, key_rows), schema), "links")
    pairs = found.where("not hot").select("a", "b")
    hot = found.where("hot").select("key", F.col("a").alias("print"))
    if hot.isEmpty():
        return pairs
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(key_rows)).cast("bigint").alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("print"), "blocks")).withColumn(
        "other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(
        F.col("own") == F.col("other"), zero).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("bigint").alias(
        "side"), "print")
    order = ["key", "low", "high"]
    more = map_arrow(dealt.repartition(tasks, *order).sortWithinPartitions(*order),
                     lambda batches: _compare(batches, None), schema)
    return pairs.unionByName(more.select("a", "b"))


def groups(prints: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Per distinct fingerprint of ``doc_id, print`` rows: its component's smallest doc_id and where that row is.

    ``keeper`` is the fingerprint of the component's first row, by doc_id, then fingerprint.
    """
    nodes = materialize(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "prints")
    found = _led(nodes.withColumnRenamed("print", "node"), connected(near_links(nodes, key_rows)))
    return found.withColumnRenamed("node", "print")


def _led(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, component_id, keeper`` of ``node, first`` rows and the components of those that are linked."""
    labelled = nodes.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    # Nulls last: the smallest known id leads.
    lead = F.min(F.struct(F.col("first").isNull().alias("unknown"), "first", "node")).alias("lead")
    leads = labelled.groupBy("component").agg(lead).select(
        "component", F.col("lead.first").alias("component_id"), F.col("lead.node").alias("keeper"))
    return labelled.join(leads, "component").select("node", "component_id", "keeper")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id, per row of ``docs``."""
    prints = materialize(fingerprints(docs), "fingerprints")
    found = prints.join(groups(prints), "print")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def near_pairs(runs: np.ndarray, sides: np.ndarray, labels: np.ndarray, prints: np.ndarray, sizes: np.ndarray,
               odd: np.ndarray, spanning: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one run, of different labels and not on one side above 0, with near fingerprints and parities.

    ``spanning`` takes the labels of a pair for one from then on: the pairs still connect all that are connected.
    """
    found_a, found_b, shift = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    bits = prints.view(np.uint64)
    alive = np.arange(len(runs))
    while True:
        alive = alive[:np.searchsorted(alive, len(runs) - shift)]
        alive = alive[runs[alive] == runs[alive + shift]]
        if not len(alive):
            return np.concatenate(found_a), np.concatenate(found_b)
        other = alive + shift
        ask = (labels[alive] != labels[other]) & ((sides[alive] != sides[other]) | (sides[alive] == 0))
        ask[ask] = np.bitwise_count(bits[alive[ask]] ^ bits[other[ask]]) <= DISTANCE
        i, j = alive[ask], other[ask]
        close = within_parities(odd[i], odd[j], sizes[i] + sizes[j])
        i, j = i[close], j[close]
        found_a.append(i)
        found_b.append(j)
        if spanning and len(i):
            tied, to = forest(labels[i], labels[j])
            at = np.minimum(np.searchsorted(tied, labels), len(tied) - 1)
            labels = np.where(tied[at] == labels, to[at], labels)
        shift += 1


def _near_pairs(held: DataFrame, families: DataFrame, labels: DataFrame | None, key_rows: int = KEY_ROWS) -> DataFrame:
    """Pairs ``a, b`` of digests with near fingerprints whose parities leave them similar.

    Without ``labels`` (node, component) pairs enough to connect what such pairs connect, with them all such pairs of
    different components. ``families`` are the components of the fingerprints; only texts of one family meet.
    """
    family = families.select(F.col("node").alias("print"), "component")
    rows = held.select("digest", "print", "size", "odd").join(family, "print", "left")
    label = F.col("digest")
    if labels is not None:
        rows = rows.join(labels.select(F.col("node").alias("digest"), F.col("component").alias("linked")), "digest", "left")
        label = F.coalesce("linked", "digest")
    labelled = materialize(rows.select(F.coalesce("component", "print").alias("key"), "digest", label.alias("label"),
                                       "print", "size", "odd"), "families")

    find = partial(near_pairs, spanning=labels is None)
    return map_arrow(in_blocks(labelled, key_rows), lambda batches: meetings(batches, find, "print", "size", "odd"),
                     "a long, b long").distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest doc_id; all columns unchanged.

    Equal texts are linked, and texts with a similarity of 0.8 of their five-word shingles. Near fingerprints propose
    pairs, and the shingles decide: texts that share a long template have near fingerprints without being copies. All
    pairs within ``DISTANCE`` bits are judged here and by nothing else; ``shingle_links`` finds the similar texts beyond.
    Texts without a word are copies of one another.
    """
    node_, twin = fresh(docs, "node_of_text", "twin_of_row")
    blank = F.xxhash64(F.lit(""))

    def node(text):
        return F.when(F.btrim(text, F.lit(BLANKS)) != "", F.xxhash64(text)).otherwise(blank)

    texts = doc_rows(docs).withColumn("node", node(F.col("text")))
    ids = materialize(texts.select("doc_id", "node"), "ids")
    nodes = materialize(ids.groupBy("node").agg(F.min("doc_id").alias("first")), "nodes")
    worded = texts.where(F.col("node") != blank).select(F.col("node").alias("digest"), "text")
    held = materialize(profiles(worded, fingerprint), "profiles")
    families = materialize(connected(near_links(held.select("print").distinct())), "print-families")
    near = partial(_near_pairs, held, families)
    labels = shingle_components(worded, near(None), held=held, near=near, distance=DISTANCE)
    keepers = materialize(_led(nodes, labels), "groups").where("node = keeper").select(
        F.col("keeper").alias("_keeper"), F.col("component_id").alias("_keeper_id"))
    kept = docs.withColumn(node_, node(F.col("text").cast("string"))).join(keepers, (F.col(node_) == F.col(
        "_keeper")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_keeper_id")), "left_semi")
    rows = ids.join(keepers, (F.col("node") == F.col("_keeper")) & F.col("doc_id").eqNullSafe(
        F.col("_keeper_id")), "left_semi").count()
    if rows > keepers.count():
        # Rows that share the id and the text of a keeper: one of them stays.
        one = Window.partitionBy(node_, "doc_id").orderBy(F.xxhash64("text"))
        kept = kept.withColumn(twin, F.row_number().over(one)).where(F.col(twin) == 1).drop(twin)
    return kept.drop(node_)
