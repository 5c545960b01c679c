"""Byte-level BPE over a corpus: each distinct pre-token is encoded once, ids are joined back by position.

1. *Explode.* Documents are read in blocks. A block numbers its distinct pre-tokens, the most frequent first, and
   keeps the sequence of numbers, which is the position of every pre-token (``codes`` row). Its distinct pre-tokens
   go out in buckets of a content hash (``words`` rows): the combine step that makes a word of a million occurrences
   one entry per block.
2. *Encode.* One shuffle brings equal pre-tokens of all blocks together; each is merged by its ranks once.
3. *Join.* The ids go back to their blocks, where positions pick them up, document by document.
4. *Decode.* Ids are joined with the token-byte table, whose size is the vocabulary.

What is shuffled is compressed binary, a few bytes per distinct word and block and about two per pre-token.

Defined cases: null is the empty text, which has no ids; repeated rows and null ``doc_id`` values are rows like any
other; an empty table gives none; a text longer than a block is a block of its own, held by one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame

from echoloom.llm.batches import blocks, doc_rows, map_arrow
from echoloom.llm.token_files import gather
from echoloom.session import scratch_dir

# Bytes of text whose distinct words are numbered together.
BLOCK_BYTES = 10 << 20
# Distinct words leave a block in this many rows at most, some kilobytes each, however many tasks encode them.
BUCKETS = 96
# Distinct words that a task remembers; beyond, it starts anew, which changes the work only.
KNOWN_WORDS = 500_000
# Fixed value: the White_Space property, which is what \s means to the pattern's engine.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SEGMENT = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# Characters that no Unicode version has reclassified.
_OLD = regex.compile(r"[\x00-\u024f]*")
_LETTERS = regex.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
# Rows between the steps; ``homes`` has the bucket of each word of a block, in the order of the numbers.
_ROWS = "block string, bucket int, kind string, doc_ids array<bigint>, n array<bigint>, payload binary, homes binary"


@lru_cache(maxsize=4)
def pretoken_pattern(pattern: str):
    """The split pattern with its white space spelled out, so that both engines agree on it."""
    spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    return regex.compile(spelled)


@lru_cache(maxsize=1)
def _stand_ins() -> dict[int, str]:
    """Characters whose class differs between the two engines' Unicode versions, and what to match in their place."""
    import tiktoken

    raw = {bytes([i]): i for i in range(256)}
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found: dict[int, str] = {}
    for part, member in ((r"\p{L}", "a"), (r"\p{N}", "1")):
        theirs = set(bytes(tiktoken.Encoding("probe", pat_str=part, mergeable_ranks=raw, special_tokens={})
                           .encode_ordinary(text)).decode())
        ours = set(regex.findall(part, text))
        found |= {ord(c): "\ue000" for c in ours - theirs} | {ord(c): member for c in theirs - ours}
    return found


def split(text: str, pattern: str) -> list[str]:
    """The matches of the pattern, as the tokenizer's own engine finds them."""
    find = pretoken_pattern(pattern)
    if _OLD.fullmatch(text) or (masked := text.translate(_stand_ins())) == text:
        return find.findall(text)
    return [text[m.start():m.end()] for m in find.finditer(masked)]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _encoding(path: str):
    """An encoding that merges whatever it is given as one piece."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=load_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[list[bytes], list[bytes]]:
    """By id: the token's bytes, and its id as decimal digits."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table, [str(i).encode() for i in range(len(table))]


def pack(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32 as byte planes, compressed."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def number_words(texts: list[str], pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct pre-tokens, their numbers in order of occurrence, pre-tokens per text).

    Texts are first cut at white space, where the pattern always cuts, so each distinct piece is matched once.
    """
    pieces: dict[str, int] = {}
    number = pieces.setdefault
    coded = []
    for text in texts:
        found = _SEGMENT.findall(text)
        coded.append(np.fromiter((number(s, len(pieces)) for s in found), np.int32, len(found)))
    per_text = np.fromiter(map(len, coded), np.int64, len(coded))
    numbers: dict[str, int] = {}
    flat: list[int] = []
    ends: list[int] = []
    plain = _LETTERS.fullmatch
    for segment in pieces:
        if plain(segment):
            flat.append(numbers.setdefault(segment, len(numbers)))
        else:
            flat += [numbers.setdefault(word, len(numbers)) for word in split(segment, pattern)]
        ends.append(len(flat))
    codes, n = gather(np.array(flat, np.int64), np.array(ends, np.int64),
                      np.concatenate([np.zeros(0, np.int32), *coded]))
    total = np.concatenate([[0], np.cumsum(n)])
    cuts = np.concatenate([[0], np.cumsum(per_text)])
    return list(numbers), codes, np.diff(total[cuts])


def explode_words(docs: DataFrame, pattern: str, buckets: int) -> DataFrame:
    """One ``codes`` row per block, and its distinct pre-tokens as one ``words`` row per bucket."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(blocks(batches, BLOCK_BYTES)):
            words, codes, n = number_words(texts, pattern)
            raw = [w.encode("utf-8") for w in words]
            frequent = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[frequent] = np.arange(len(words))
            raw = [raw[i] for i in frequent.tolist()]
            home = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            rows = [(f"{part}-{number}", -1, "codes", ids, n.tolist(), pack(rank[codes]), pack(home))]
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(buckets + 1))
            for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                at = order[cuts[bucket]:cuts[bucket + 1]].tolist()
                payload = zstandard.compress(b"".join(raw[i] for i in at), 3)
                rows.append((f"{part}-{number}", bucket, "words", None, [len(raw[i]) for i in at], payload, None))
            yield _rows(rows)

    return map_arrow(doc_rows(docs), run, _ROWS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(),
             pa.binary())
    names = ("block", "bucket", "kind", "doc_ids", "n", "payload", "homes")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


def encode_words(words: DataFrame, path: str, tasks: int) -> DataFrame:
    """``ids`` rows for the ``words`` rows: each distinct pre-token meets its ranks once, in its bucket's task."""
    def run(batches):
        encode = _encoding(path).encode_ordinary
        known: dict[bytes, list[int]] = {}
        last = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != last or len(known) > KNOWN_WORDS:
                    known, last = {}, row["bucket"]
                data = zstandard.decompress(row["payload"])
                ends = np.cumsum(row["n"]).tolist()
                out = []
                for a, b in zip([0, *ends], ends):
                    word = data[a:b]
                    if (ids := known.get(word)) is None:
                        ids = known[word] = encode(word.decode())
                    out.append(ids)
                flat = np.fromiter((i for ids in out for i in ids), np.int64)
                yield _rows([(row["block"], row["bucket"], "ids", None, list(map(len, out)), pack(flat), None)])

    # A bucket's blocks meet in one task, one bucket after the other.
    return map_arrow(words.repartition(tasks, "bucket").sortWithinPartitions("bucket"), run, _ROWS)


def assemble(block: pa.Table, ids: pa.Table, path: str) -> pa.Table:
    """Per document of a block: its ids picked up by position, digested, and decoded again."""
    own = block.to_pylist()[0]
    codes, homes = unpack(own["payload"]), unpack(own["homes"])
    found = sorted(ids.to_pylist(), key=lambda r: r["bucket"])
    # A bucket lists its words in the order of their numbers, so sorting the numbers by bucket finds them again.
    flat = np.concatenate([np.zeros(0, np.int64), *(unpack(r["payload"]) for r in found)])
    ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *(np.array(r["n"], np.int64) for r in found)]))
    place = np.empty(len(homes), np.int64)
    place[np.argsort(homes, kind="stable")] = np.arange(len(homes))
    ids, per_word = gather(flat, ends, place[codes])
    total = np.concatenate([[0], np.cumsum(per_word)])
    cuts = total[np.concatenate([[0], np.cumsum(own["n"])]).astype(np.int64)].tolist()
    raw, digits = token_bytes(path)
    id_digests, text_digests = [], []
    for a, b in zip(cuts, cuts[1:]):
        doc = ids[a:b].tolist()
        id_digests.append(hashlib.sha256(b",".join([digits[i] for i in doc])).hexdigest())
        text_digests.append(hashlib.sha256(b"".join([raw[i] for i in doc])).hexdigest())
    return pa.table({"doc_id": pa.array(own["doc_ids"], pa.int64()), "n_tokens": pa.array(np.diff(cuts), pa.int64()),
                     "ids_sha256": pa.array(id_digests, pa.string()),
                     "decoded_sha256": pa.array(text_digests, pa.string())})


def _stored_by_block(rows: DataFrame, buckets: int) -> DataFrame:
    """The exploded rows as a table bucketed by block: the codes, the bulk of it, then meet the ids unshuffled."""
    spark = rows.sparkSession
    name = f"pretokens_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, "block").option("path", scratch_dir(spark, "pretokens")).saveAsTable(name)
    stored = spark.table(name)
    # The frame knows files and buckets; only the name goes, the files of an external table stay.
    spark.sql(f"DROP TABLE {name}")
    return stored


def encode_corpus(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens, the digest of the ids and the digest of the decoded bytes, per row of ``docs``."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = _stored_by_block(explode_words(docs, pattern, BUCKETS), tasks)
    ids = encode_words(exploded.where("kind = 'words'"), path, tasks)
    codes = exploded.where("kind = 'codes'")
    return codes.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        lambda block, found: assemble(block, found, path),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
