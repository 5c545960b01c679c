"""JSON documents of any size, read by many tasks.

A file that holds one JSON value cannot be cut where it looks convenient: whether a comma parts two records depends on
all quotes and brackets before it. So the text is read in fragments between commas, which Spark's splits deliver in
order, and scanned three times without moving it:

1. every split counts its quotes and brackets, once as if it began outside a string and once inside; put together in
   order, these counts give the string state and the depth at the start of each split;
2. with them, every split finds the documents and the wanted lists that open in it, which gives the list that is open
   at the start of each split;
3. with that, every split cuts its records. Of a record that crosses splits, the pieces are put together, two rows per
   split at most.

Between the scans, one small row per split (128 MB by default) goes to the driver. Files of a folder count as one text
in the order of their names: a file may hold a document, several, or a part of one (see ``sinks.files``). Text outside
a document, an open string or bracket at the end of a folder, or an empty record fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.functions.text import dirname
from echoloom.operators.spread import lookup_join
from echoloom.session import materialize

# Where a record is looked for: in lists (the document itself, or lists under wanted keys of an object), among the
# entries of objects, or as whole documents.
RECORDS, ENTRIES, WHOLE = "records", "entries", "whole"
# Label of the list or object that is a document itself.
ITSELF = ""
_OUT_BYTES = 4 << 20
_BLANK = b" \t\n\r"

Split = tuple[str, int]


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", ",").text(path).select(
        F.col("value").cast("binary").alias("value"), meta["file_path"].alias("file"),
        meta["file_block_start"].alias("block"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Split, bytes, bool]]:
    """(split, text, whether the split ends here), with a comma after each fragment but the last of the split."""
    split: Split | None = None
    comma = b""
    for batch in batches:
        values, files, blocks = (batch.column(i) for i in range(3))
        codes = files.dictionary_encode()
        place, block = codes.indices.to_numpy().astype(np.int64), blocks.to_numpy()
        cuts = np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1
        begin = 0
        for end in [*cuts.tolist(), batch.num_rows]:
            if end == begin:
                continue
            own = (codes.dictionary[int(place[begin])].as_py(), int(block[begin]))
            if own != split:
                if split is not None:
                    yield split, b"", True
                split, comma = own, b""
            yield split, comma + b",".join(values.slice(begin, end - begin).to_pylist()), False
            comma, begin = b",", end
    if split is not None:
        yield split, b"", True


class Structure:
    """Strings and brackets of a piece of text that begins inside or outside a string, at some depth."""

    def __init__(self, text: bytes, quoted: int = 0, depth: int = 0):
        hidden = re.sub(rb"\\.", b"__", text, flags=re.S) if b"\\" in text else text
        self.chars = np.frombuffer(hidden, np.uint8)
        self.quotes = self.chars == ord('"')
        inside = (np.cumsum(self.quotes, dtype=np.int32) + quoted) & 1
        self.inside = inside.astype(bool)
        self.outside = ~(self.inside | self.quotes)
        self.step = np.zeros(len(self.chars), np.int8)
        for mark, step in zip(b"[{]}", (1, 1, -1, -1)):
            self.step[self.chars == mark] = step
        self.all_steps = int(self.step[~self.quotes].sum())
        self.step[~self.outside] = 0
        self.depth = np.cumsum(self.step, dtype=np.int32) + depth
        self.quoted_after = int(inside[-1]) if len(inside) else quoted
        self.depth_after = int(self.depth[-1]) if len(self.depth) else depth


def _batch(rows: list[tuple], fields: Sequence[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


# ---------------------------------------------------------------- first scan

def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parity, steps = 0, [0, 0]
    for split, text, done in _runs(batches):
        found = Structure(text)
        outside = int(found.step.sum())
        both = (outside, found.all_steps - outside)
        steps = [steps[0] + both[parity], steps[1] + both[1 - parity]]
        parity ^= found.quoted_after
        if done:
            yield _batch([(*split, parity, *steps)], _COUNTS)
            parity, steps = 0, [0, 0]


_COUNTS = (("file", pa.string()), ("block", pa.int64()), ("parity", pa.int32()), ("plain", pa.int64()),
           ("quoted", pa.int64()))


def _states(counts: DataFrame) -> dict[Split, tuple[int, int, bytes]]:
    """(inside a string, depth) at the start of every split, and the comma that ends it, which a file's end has not."""
    found: dict[Split, tuple[int, int, bytes]] = {}
    folder, quoted, depth = None, 0, 0
    rows = counts.withColumn("folder", dirname("file")).orderBy("folder", "file", "block").collect()  # one per split
    for r, after in zip(rows, [*rows[1:], None]):
        if r.folder != folder:
            _closed(folder, quoted, depth)
            folder, quoted, depth = r.folder, 0, 0
        found[r.file, r.block] = (quoted, depth, b"," if after and after.file == r.file else b"")
        depth += r.quoted if quoted else r.plain
        quoted ^= r.parity
    _closed(folder, quoted, depth)
    return found


def _closed(folder: str | None, quoted: int, depth: int) -> None:
    if quoted or depth:
        raise ValueError(f"MALFORMED: a document in {folder} ends inside a string or bracket (depth {depth})")


# ---------------------------------------------------------------- second scan

class Opening:
    """A document or wanted list that opens.

    ``at`` is where its content begins, ``label`` the key (None if no record is looked for in it), ``level`` the depth of
    its records, ``document`` the bracket if it is a document itself.
    """

    __slots__ = ("at", "label", "level", "empty", "document")

    def __init__(self, at, label, level, empty, document):
        self.at, self.label, self.level, self.empty, self.document = at, label, level, empty, document


_EMPTY = re.compile(rb"\s*[\]}]")


def _key_pattern(keys: Sequence[str]):
    if any("," in k for k in keys):
        raise ValueError("a wanted key has no comma")
    return re.compile(rb'"(' + b"|".join(re.escape(k.encode()) for k in keys) + rb')"\s*:\s*\[') if keys else None


def _openings(text: bytes, s: Structure, keys, mode: str) -> list[Opening]:
    """Documents and wanted lists that open in the text, in order; a document that holds no records itself too."""
    stray = s.quotes | s.outside
    stray &= (s.depth == 0) & (s.step == 0)
    if stray.any():
        extra = s.chars[stray]
        if not np.isin(extra, np.frombuffer(_BLANK, np.uint8)).all():
            raise ValueError("MALFORMED: text outside a JSON document")
    found = []
    for at in np.flatnonzero((s.step == 1) & (s.depth == 1)).tolist():
        is_list = s.chars[at] == ord("[")
        holds = mode == (RECORDS if is_list else ENTRIES)
        found.append(Opening(at + 1, ITSELF if holds else None, 1 if holds else 0,
                             bool(_EMPTY.match(text, at + 1)), "[" if is_list else "{"))
    if keys is not None and mode == RECORDS:
        for m in keys.finditer(text):
            at, bracket = m.start(), m.end() - 1
            if s.quotes[at] and s.inside[at] and s.depth[at] == 1 and s.outside[bracket] and s.depth[bracket] == 2:
                found.append(Opening(m.end(), m[1].decode(), 2, bool(_EMPTY.match(text, m.end())), None))
    found.sort(key=lambda o: o.at)
    return found


_EVENTS = (("file", pa.string()), ("block", pa.int64()), ("low", pa.int32()), ("documents", pa.int64()),
           ("open_label", pa.string()), ("open_level", pa.int32()), ("objects", pa.list_(pa.int64())),
           ("filled", pa.bool_()), ("labels", pa.list_(pa.string())))
_EVENTS_DDL = ("file string, block long, low int, documents long, open_label string, open_level int, "
               "objects array<bigint>, filled boolean, labels array<string>")


class _Found:
    """What opens in one split."""

    def __init__(self, depth: int):
        self.low, self.documents, self.filled = depth, 0, False
        self.open: tuple[str, int] | None = None
        self.labels: set[str] = set()
        # Twice the number of an object within the split, plus one if it has records.
        self.objects: list[int] = []

    def feed(self, s: Structure, openings: list[Opening]) -> None:
        begin = 0
        for o in openings:
            if o.document:
                self.documents += 1
                if o.document == "{" and o.label is None:
                    self.objects.append(2 * self.documents)
            elif not o.empty and self.objects:
                self.objects[-1] |= 1
            elif not o.empty:
                self.filled = True
            if o.label is not None:
                self.open, begin = (o.label, o.level), o.at
                self.labels.add(o.label)
        if self.open and (s.depth[begin:] < self.open[1]).any():
            self.open = None
        self.low = min(self.low, int(s.depth.min(initial=self.low)))


def _find(states: dict[Split, tuple], keys: Sequence[str], mode: str):
    pattern = _key_pattern(keys)

    def run(batches):
        found = None
        for split, text, done in _runs(batches):
            if found is None:
                quoted, depth, comma = states[split]
                found = _Found(depth)
            text = comma if done else text
            s = Structure(text, quoted, depth)
            found.feed(s, _openings(text, s, pattern, mode))
            quoted, depth = s.quoted_after, s.depth_after
            if done:
                yield _batch([(*split, found.low, found.documents, *(found.open or (None, None)), found.objects,
                               found.filled, sorted(found.labels))], _EVENTS)
                found = None

    return run


def _starts(states: dict[Split, tuple], events: DataFrame) -> tuple[dict[Split, tuple], set[str]]:
    """(inside a string, depth, (label, level) of the open list, documents before, comma after) by split; all labels."""
    starts: dict[Split, tuple] = {}
    labels: set[str] = set()
    folder, documents, active = None, 0, None
    rows = events.withColumn("folder", dirname("file")).orderBy("folder", "file", "block").select(
        "folder", "file", "block", "low", "documents", "open_label", "open_level", "labels")
    for r in rows.collect():  # one row per split
        if r.folder != folder:
            folder, active = r.folder, None
        quoted, depth, comma = states[r.file, r.block]
        starts[r.file, r.block] = (quoted, depth, active, documents, comma)
        labels.update(r.labels)
        documents += r.documents
        if r.open_label is not None:
            active = (r.open_label, r.open_level)
        elif active and (r.labels or r.low < active[1]):
            active = None
    return starts, labels


def _without_records(spark: SparkSession, events: DataFrame, starts: dict[Split, tuple]) -> DataFrame:
    """``document`` of the objects that hold no record under a wanted key."""
    before = spark.createDataFrame([(*split, start[3]) for split, start in starts.items()],
                                   "file string, block long, before long")  # one row per split
    placed = events.select("file", "block", "objects", "filled").join(F.broadcast(before), ["file", "block"])
    opened = placed.select("before", F.explode("objects").alias("o")).select(
        (F.col("before") + F.shiftright("o", 1)).alias("document"), (F.col("o") % 2 == 1).alias("has"))
    later = placed.where("filled").select(F.col("before").alias("document"), F.lit(True).alias("has"))
    return opened.unionByName(later).groupBy("document").agg(F.bool_or("has").alias("has")).where("not has").select(
        "document")


# ---------------------------------------------------------------- third scan

_PIECES = (("folder", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()),
           ("document", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("value", pa.string()))
_PIECES_DDL = "folder string, file string, block long, n long, document long, label string, kind string, value string"


class Cutter:
    """Cuts the records of one split. ``kind`` is whole, or for pieces tail (a record begins), through, head (it ends)."""

    def __init__(self, split: Split, start: tuple, keys, mode: str):
        self.split, self.keys, self.mode = split, keys, mode
        self.quoted, self.depth, self.active, self.document, self.comma = start
        if mode == WHOLE:
            self.active = (ITSELF, 0) if self.depth else None
        self.folder = split[0].rsplit("/", 1)[0]
        self.pending: list[bytes] = []
        self.began = False
        self.n = 0

    def _row(self, text: bytes, kind: str) -> tuple:
        self.n += 1
        return (self.folder, *self.split, self.n, self.document, self.active[0], kind, text.decode())

    def _cut(self, text: bytes) -> tuple:
        """A record that ends here; the next one begins here."""
        text = b"".join([*self.pending, text])
        kind = "whole" if self.began else "head"
        if self.began and not text.strip(_BLANK):
            raise ValueError("MALFORMED: an empty record")
        self.pending, self.began = [], True
        return self._row(text, kind)

    def feed(self, text: bytes) -> Iterator[tuple]:
        s = Structure(text, self.quoted, self.depth)
        begin = 0
        for o in (None, *_openings(text, s, self.keys, self.mode)):
            if o is not None:
                self.document += bool(o.document)
                if self.mode == WHOLE:
                    self.active, begin = (ITSELF, 0), o.at - 1
                elif o.label is None or o.empty:
                    continue
                else:
                    self.active, begin = (o.label, o.level), o.at
                self.pending, self.began = [], True
            if self.active is not None:
                yield from self._span(text, s, begin)
        self.quoted, self.depth = s.quoted_after, s.depth_after

    def _span(self, text: bytes, s: Structure, begin: int) -> Iterator[tuple]:
        """The records of the open list from ``begin`` on, to its end or that of the text."""
        level = self.active[1]
        whole = self.mode == WHOLE
        shut = np.flatnonzero((s.step[begin:] == -1) & (s.depth[begin:] == (0 if whole else level - 1)))
        end = begin + int(shut[0]) if len(shut) else len(text)
        if not whole:
            part = slice(begin, end)
            commas = np.flatnonzero((s.chars[part] == ord(",")) & s.outside[part] & (s.depth[part] == level)) + begin
            for cut in commas.tolist():
                yield self._cut(text[begin:cut])
                begin = cut + 1
        if len(shut):
            yield self._cut(text[begin:end + whole])
            self.active = None
        else:
            self.pending.append(text[begin:])

    def rest(self) -> Iterator[tuple]:
        if self.active is not None:
            yield self._row(b"".join(self.pending), "tail" if self.began else "through")


def _cut(starts: dict[Split, tuple], keys: Sequence[str], mode: str, whole: bool):
    pattern = _key_pattern(keys)

    def rows(batches):
        cutter = None
        for split, text, done in _runs(batches):
            cutter = cutter or Cutter(split, starts[split], pattern, mode)
            yield from cutter.feed(cutter.comma if done else text)
            if done:
                yield from cutter.rest()
                cutter = None

    def run(batches):
        held, size = [], 0
        for row in rows(batches):
            if (row[6] == "whole") == whole:
                held.append(row)
                size += len(row[7])
                if size > _OUT_BYTES:
                    yield _batch(held, _PIECES)
                    held, size = [], 0
        if held:
            yield _batch(held, _PIECES)

    return run


def _join_pieces(pieces: DataFrame) -> DataFrame:
    """Records that cross splits, at most two pieces of each split."""
    order = Window.partitionBy("folder").orderBy("file", "block", "n")
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    part = F.struct("file", "block", "n", "document", "label", "value")
    joined = numbered.groupBy("folder", "record").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    head = F.get("parts", F.lit(0))
    return joined.select(
        "folder", *[head[c].alias(c) for c in ("file", "block", "n", "document", "label")], F.lit("whole").alias("kind"),
        F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value"))


class Documents:
    """The documents below a path, scanned for the records under ``keys`` (or of lists, or the entries of objects)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), mode: str = RECORDS):
        self.spark, self.keys, self.mode = spark, tuple(keys), mode
        # Fragments are short, so a batch is bounded by their number; a long one is a batch of few.
        self.fragments = _fragments(spark, path)
        states = _states(self.fragments.mapInArrow(_count, "file string, block long, parity int, plain long, quoted long"))
        self.events = materialize(self.fragments.mapInArrow(_find(states, self.keys, mode), _EVENTS_DDL), "json-events")
        self.starts, self.labels = _starts(states, self.events)

    def _records(self, mode: str) -> DataFrame:
        def scan(whole):
            return self.fragments.mapInArrow(_cut(self.starts, self.keys, mode, whole), _PIECES_DDL)

        found = scan(True)
        if any(start[1 if mode == WHOLE else 2] for start in self.starts.values()):
            found = found.unionByName(_join_pieces(scan(False)))
        return found

    def records(self) -> DataFrame:
        """``document, label, file, block, n, value``: the text of each record, and where it begins.

        In a task they come by document and label, in the order of the keys.
        """
        found = self._records(self.mode)
        if len(self.labels) > 1:
            place = F.array_position(F.array(*[F.lit(k) for k in self.keys]), F.col("label"))
            found = found.sortWithinPartitions("document", place, "file", "block", "n")
        return found

    def whole(self) -> DataFrame | None:
        """Objects without a record under a wanted key, as records themselves; None if there is none."""
        alone = _without_records(self.spark, self.events, self.starts)
        if alone.limit(1).count() == 0:
            return None
        return lookup_join(self._records(WHOLE), alone, "document", "inner")
