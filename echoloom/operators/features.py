"""Model inputs of questions and contexts: sub-word tokens with their characters, windows, masks, answer positions.

The tokenizer is injected; it sees the distinct words of a piece of a batch. What it returns stays two arrays of numbers per text,
where each token begins and ends; windows, masks and positions are expressions over them, row by row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, col
from echoloom.operators.scoring import chunk_starts

# Words of a piece -> per word its tokens as (id, characters).
Tokenizer = Callable[[list[str]], list[list[tuple[int, int]]]]
TOKENS = "ids array<int>, starts array<int>, ends array<int>"
_WORD = re.compile(r"\S+")
# Bytes of text that are tokenized at once.
PIECE_BYTES = 1 << 18
# Special tokens beside the question and the window: one before, one after each.
MARKS = 3
FEATURE = ("chunk", "input_ids", "attention_mask", "token_type_ids", "cls_index", "p_mask", "is_impossible",
           "start_position", "end_position", "token_starts", "token_ends")


class Special(NamedTuple):
    """Ids of the tokens that open, part and fill a feature."""

    cls: int
    sep: int
    pad: int


def encode(text: ColumnLike, tokenizer: Tokenizer) -> Column:
    """``{ids, starts, ends}``: the tokens of a text, and the characters each stands for, ends exclusive.

    A batch is taken in pieces of at most ``PIECE_BYTES`` of text or one text; each distinct word of a piece is
    tokenized once. What stays of a piece are its numbers. Null has no tokens.
    """
    @F.arrow_udf(TOKENS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_encoded(p.to_pylist(), tokenizer) for p in pieces(texts)])

    return run(col(text))


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of texts of at most ``PIECE_BYTES``; a longer text is a run of its own, no text is one empty run."""
    at = size = 0
    for n, length in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if n > at and size + length > PIECE_BYTES:
            yield texts.slice(at, n - at)
            at, size = n, 0
        size += length
    yield texts.slice(at)


def _encoded(texts: list[str | None], tokenizer: Tokenizer) -> pa.Array:
    """The tokens of each text as ``TOKENS``, in flat arrays of 32 bits."""
    words = list(dict.fromkeys(w for t in texts for w in _WORD.findall(t or "")))
    known = dict(zip(words, tokenizer(words)))
    ids, starts, ends, offsets = array("i"), array("i"), array("i"), array("i", [0])
    for text in texts:
        for m in _WORD.finditer(text or ""):
            at, stop, found = m.start(), m.end(), known[m[0]]
            for n, (i, length) in enumerate(found, 1):
                ids.append(i)
                starts.append(at)
                # The last token of a word ends with it, whatever a normaliser did to its length.
                at = stop if n == len(found) else min(at + length, stop)
                ends.append(at)
        offsets.append(len(ids))
    flat = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (ids, starts, ends))
    cuts = pa.array(np.frombuffer(offsets, np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(x)) for x in flat],
                                      ["ids", "starts", "ends"])


def token_span(starts: Column, ends: Column, first: Column, last: Column) -> Column:
    """``{first, last}`` token of the characters ``first`` to ``last``, both included; offsets rise, so counts find them."""
    return F.struct(F.size(F.filter(ends, lambda e: e <= first)).alias("first"),
                    (F.size(F.filter(starts, lambda s: s <= last)) - 1).alias("last"))


def model_inputs(df: DataFrame, tokenizer: Tokenizer, special: Special, max_seq_length: int = 512, stride: int = 128,
                 max_query_length: int = 64) -> DataFrame:
    """One row per window of each context: the input columns but ``question`` and ``context``, and ``FEATURE``.

    ``df`` has ``question, context, answer, answer_start``. A feature is opening mark, question (cut to
    ``max_query_length``), mark, window, mark, then filling up to ``max_seq_length``. ``p_mask`` is 0 where an answer may
    be: at the window and at the opening mark, ``cls_index``, where an answer outside the window points. A null or empty
    answer makes the question impossible. ``token_starts`` and ``token_ends`` lead tokens of the window back to
    characters of the context.
    """
    if max_seq_length - MARKS - max_query_length <= 0:
        raise ValueError("max_query_length leaves no room for the context")
    rest = [c for c in df.columns if c not in ("question", "context")]
    coded = df.withColumns({"_q": encode("question", tokenizer), "_c": encode("context", tokenizer)})
    begin = F.col("answer_start").cast("int")
    known = (F.length("answer") > 0) & begin.isNotNull()
    span = token_span(F.col("_c.starts"), F.col("_c.ends"), begin, begin + F.length("answer") - 1)
    sized = coded.withColumns({
        "_query": F.slice("_q.ids", 1, max_query_length), "_span": F.when(known, span),
    }).withColumn("_room", F.lit(max_seq_length - MARKS) - F.size("_query"))
    starts = chunk_starts(F.size("_c.ids"), F.col("_room"), F.least(F.col("_room"), F.lit(stride)))
    windows = sized.select("*", F.posexplode(starts).alias("chunk", "_at"))
    part = lambda name: F.slice(F.col(f"_c.{name}"), F.col("_at") + 1, F.col("_room"))
    cut = windows.withColumns({"_window": part("ids"), "token_starts": part("starts"), "token_ends": part("ends")})
    one = lambda n: F.array(F.lit(n))
    many = lambda n, size: F.array_repeat(F.lit(n), size)
    query, window = F.size("_query"), F.size("_window")
    fill = F.lit(max_seq_length - MARKS) - query - window
    offset = query + 2
    first, last = F.col("_span.first") - F.col("_at"), F.col("_span.last") - F.col("_at")
    inside = F.coalesce((first >= 0) & (last < window), F.lit(False))
    return cut.select(
        *rest, "chunk",
        F.concat(one(special.cls), "_query", one(special.sep), "_window", one(special.sep), many(special.pad, fill))
        .alias("input_ids"),
        F.concat(many(1, query + window + MARKS), many(0, fill)).alias("attention_mask"),
        F.concat(many(0, offset), many(1, window + 1), many(0, fill)).alias("token_type_ids"),
        F.lit(0).alias("cls_index"),
        F.concat(one(0), many(1, offset - 1), many(0, window), many(1, fill + 1)).alias("p_mask"),
        F.col("_span").isNull().alias("is_impossible"),
        F.when(inside, first + offset).otherwise(0).alias("start_position"),
        F.when(inside, last + offset).otherwise(0).alias("end_position"),
        "token_starts", "token_ends")
