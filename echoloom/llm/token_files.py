"""Token ids as binary files with Elias-Fano coded document boundaries.

One file holds the ids of a run of documents in ascending ``doc_id`` order, one after the other, little-endian and
two bytes wide where the vocabulary allows. Behind them stand two Elias-Fano sequences, the end of each document and
the document ids, about ``2 + log2(range / documents)`` bits an entry instead of 64, with a sampled position of every
``SAMPLE``-th one bit, from which ``select`` finds any entry by reading a few bytes. A fixed-size footer closes the file.

Documents are range-partitioned by id, so each task writes one file; it writes under a name of its own and moves the
file into place when it is whole, so a task that runs again only replaces equal bytes.

Defined cases: a null or empty text is the end id alone; null ``doc_id`` values come first; rows with equal ids stand
in the order of their texts' digests; an empty table gives no files; a long text is encoded whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, map_arrow
from echoloom.session import scratch_dir

MAGIC = b"EFTOK001"
END_ID = 1
SAMPLE = 256
# Texts are encoded together until their bytes pass this: each distinct word of such a run is encoded once.
RUN_BYTES = 24 << 20
# Documents that one reading task handles.
READ_DOCS = 8192
_FOOTER = struct.Struct("<8s9q")


# ---------------------------------------------------------------- Elias-Fano

def ef_encode(values: np.ndarray, top: int) -> tuple[int, bytes, bytes, bytes]:
    """(low bits per entry, low part, high part, samples) of ascending values in 0 … ``top``."""
    n = len(values)
    values = values.astype(np.uint64)
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    lows = np.zeros((n, low), np.uint8)
    for bit in range(low):
        lows[:, bit] = (values >> np.uint64(bit)).astype(np.uint8) & 1
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    return (low, np.packbits(lows.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())


class EliasFano:
    """Entries of a sequence, read from ``read(offset, size)`` at ``start``; nothing is decoded that is not asked for."""

    def __init__(self, read, start: int, n: int, low: int, high_bytes: int):
        self.read, self.n, self.low, self.high_bytes = read, n, low, high_bytes
        self.lows = start
        self.highs = start + (n * low + 7) // 8
        self.samples = self.highs + high_bytes

    @property
    def end(self) -> int:
        return self.samples + 4 * ((self.n + SAMPLE - 1) // SAMPLE)

    def select(self, first: int, last: int) -> np.ndarray:
        """Entries ``first`` to ``last - 1``."""
        if last <= first:
            return np.zeros(0, np.uint64)
        a, b = first // SAMPLE, (last - 1) // SAMPLE + 1
        count = (self.n + SAMPLE - 1) // SAMPLE
        marks = np.frombuffer(self.read(self.samples + 4 * a, 4 * (min(b + 1, count) - a)), "<u4")
        begin = int(marks[0]) // 8
        stop = int(marks[b - a]) // 8 + 1 if b < count else self.high_bytes
        bits = np.unpackbits(np.frombuffer(self.read(self.highs + begin, stop - begin), np.uint8), bitorder="little")
        bits[: int(marks[0]) - begin * 8] = 0
        at = np.flatnonzero(bits)[first - a * SAMPLE:last - a * SAMPLE] + begin * 8
        out = (at - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            start, stop = first * self.low, last * self.low
            raw = np.frombuffer(self.read(self.lows + start // 8, (stop + 7) // 8 - start // 8), np.uint8)
            lows = np.unpackbits(raw, bitorder="little")[start % 8:start % 8 + stop - start].reshape(-1, self.low)
            for bit in range(self.low):
                out |= lows[:, bit].astype(np.uint64) << np.uint64(bit)
        return out


# ---------------------------------------------------------------- encoding

@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# A word of letters without case folding or composition surprises, with at most one mark after it.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_LINE = 4096


def encode_words(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of each word as the tokenizers library encodes it alone."""
    out: list[list[int]] = [e.ids for e in _tokenizer(path).encode_batch(words, add_special_tokens=False)]
    lengths = np.fromiter(map(len, out), np.int64, len(out))
    ids = np.fromiter((i for e in out for i in e), np.int64, int(lengths.sum()))
    return ids, np.cumsum(lengths)


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray | None:
    """Which ids close a word, if the vocabulary marks that; else None."""
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith(suffix)
    return ends


def encode_letters(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of words of letters: many to a line, cut where an id closes a word."""
    closes = _word_ends(path)
    if closes is None or not words:
        return encode_words(words, path)
    lines = [" ".join(words[i:i + _LINE]) for i in range(0, len(words), _LINE)]
    found = [e.ids for e in _tokenizer(path).encode_batch(lines, add_special_tokens=False)]
    ids = np.fromiter((i for e in found for i in e), np.int64, sum(map(len, found)))
    ends = np.flatnonzero(closes[ids]) + 1
    return (ids, ends) if len(ends) == len(words) else encode_words(words, path)


def gather(flat: np.ndarray, ends: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picks`` of a ragged array one after the other, and their lengths."""
    lengths = np.diff(ends, prepend=0)
    n = lengths[picks]
    total = np.cumsum(n)
    starts = (ends - lengths)[picks] - (total - n)
    return flat[np.repeat(starts, n) + np.arange(total[-1] if len(total) else 0)], n


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids per text). Blanks split words in this vocabulary, so each distinct word is encoded once."""
    parts = pc.ascii_split_whitespace(texts)
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    # A trailing mark is a token of its own: word and mark are looked up apart, and case folds first.
    letters: dict[str, int] = {"": 0}
    others: dict[str, int] = {"": 0}
    head = np.zeros(len(words), np.int64)
    tail = np.zeros(len(words), np.int64)
    for i, word in enumerate(words):
        if m := _SIMPLE.fullmatch(word):
            head[i] = letters.setdefault(m[1].lower(), len(letters))
            tail[i] = others.setdefault(m[2], len(others))
        else:
            tail[i] = others.setdefault(word, len(others))
    ids, ends = encode_letters(list(letters)[1:], path)
    more, more_ends = encode_words(list(others)[1:], path)
    # Entry 0 of both tables is empty; word w is a run of the first table, then one of the second.
    flat = np.concatenate([ids, more])
    table = np.concatenate([[0], ends, [len(ids)], more_ends + len(ids)]).astype(np.int64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    picks = np.empty(2 * len(codes), np.int64)
    picks[::2] = head[codes]
    picks[1::2] = tail[codes] + len(letters)
    got, lengths = gather(flat, table, picks)
    total = np.concatenate([[0], np.cumsum(lengths)])
    offsets = parts.offsets.to_numpy().astype(np.int64)
    return got, np.diff(total[2 * (offsets - offsets[0])])


# ---------------------------------------------------------------- files

def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _runs(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their bytes pass ``limit``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _write_file(batches: Iterable[pa.RecordBatch], folder: str, part: str, path: str, end_id: int) -> tuple | None:
    store, root = _open(folder)
    width = 2 if max(_tokenizer(path).get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    temporary = f"{root}/.{part}-{uuid.uuid4().hex}"
    lengths, keys, nulls, total = [], [], 0, 0
    stream = None
    for run in _runs(batches, RUN_BYTES):
        stream = stream or store.open_output_stream(temporary)
        ids, n = encode_texts(pc.fill_null(column(run, "text"), ""), path)
        out = np.insert(ids, np.cumsum(n), end_id)
        stream.write(out.astype(f"<u{width}").tobytes())
        doc_ids = column(run, "doc_id")
        nulls += doc_ids.null_count
        keys.append(pc.drop_null(doc_ids).to_numpy())
        lengths.append(n + 1)
        total += len(out)
    if stream is None:
        return None
    n = sum(map(len, lengths))
    ids = np.concatenate(keys)
    least = int(ids[0]) if len(ids) else 0
    spread = ids.astype(np.uint64) - np.uint64(least & (2 ** 64 - 1))
    ends = ef_encode(np.cumsum(np.concatenate(lengths)), total)
    docs = ef_encode(spread, int(spread[-1]) if len(ids) else 0)
    for piece in (*ends[1:], *docs[1:]):
        stream.write(piece)
    stream.write(_FOOTER.pack(MAGIC, width, total, n, nulls, least, ends[0], len(ends[2]), docs[0], len(docs[2])))
    stream.close()
    name = f"{part}.eftok"
    store.move(temporary, f"{root}/{name}")
    return name, n, total


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the ids of every text below ``folder``; returns the manifest, one row per file.

    The manifest (``file, docs, ids, start``) gives each file the number of ids before it; it is as long as the
    number of ranges, and the only thing that reaches the driver.
    """
    spark = docs.sparkSession
    store, root = _open(folder)
    store.create_dir(root, recursive=True)

    def run(batches):
        from pyspark import TaskContext

        part = f"part-{TaskContext.get().partitionId():05d}"
        if row := _write_file(batches, folder, part, path, end_id):
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["file", "docs", "ids"])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = doc_rows(docs).withColumn("digest", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop("digest")
    rows = sorted(map(tuple, map_arrow(ordered, run, "file string, docs long, ids long").collect()))
    starts = np.cumsum([0, *(r[2] for r in rows)]).tolist()
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, starts)],
                                 "file string, docs long, ids long, start long").coalesce(1)


class TokenFile:
    """Random access to one file of ``write_tokens``."""

    def __init__(self, path: str):
        store, at = _open(path)
        self._file = store.open_input_file(at)
        size = self._file.size()
        magic, width, self.ids, self.docs, self.nulls, self.least, low, high, doc_low, doc_high = _FOOTER.unpack(
            self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.width = width
        self.ends = EliasFano(self._read, width * self.ids, self.docs, low, high)
        self.keys = EliasFano(self._read, self.ends.end, self.docs - self.nulls, doc_low, doc_high)

    def _read(self, offset: int, size: int) -> bytes:
        return self._file.read_at(size, offset)

    def bounds(self, first: int, last: int) -> np.ndarray:
        """Starts of documents ``first`` to ``last - 1`` and the end of the last, in ids of this file."""
        ends = self.ends.select(max(first - 1, 0), last).astype(np.int64)
        return ends if first else np.concatenate([[0], ends])

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        nulls = max(0, min(last, self.nulls) - first)
        known = self.keys.select(max(first, self.nulls) - self.nulls, max(last, self.nulls) - self.nulls)
        return [None] * nulls + (known + np.uint64(self.least & (2 ** 64 - 1))).astype(np.int64).tolist()

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._read(self.width * start, self.width * (stop - start)), f"<u{self.width}")

    def close(self) -> None:
        self._file.close()


def read_tokens(manifest: DataFrame, folder: str, read_docs: int = READ_DOCS) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, read in blocks of ``read_docs`` documents."""
    blocks = manifest.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(docs - 1) div {read_docs}"))).alias("block"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(f"{folder}/{row['file']}")
                try:
                    first = row["block"] * read_docs
                    last = min(first + read_docs, row["docs"])
                    bounds = file.bounds(first, last)
                    ids = file.read_ids(int(bounds[0]), int(bounds[-1])).astype("<u4")
                    cuts = bounds - bounds[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                    keys = file.doc_ids(first, last)
                finally:
                    file.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(bounds[:-1] + row["start"]),
                     pa.array(np.diff(bounds)), pa.array(crc, pa.int64())], names)

    return map_arrow(blocks.repartition(tasks, "file", "block"), run,
                     "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of ``docs`` to the scratch folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path), folder)
