"""Chunk long contexts, score them, and rank candidate answers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, col, let, tokens

# Chunks that are scored at once; of each batch only their scores stay, in flat arrays.
SCORED = 256

# question words and chunk words of some chunks -> start and end scores of the words of each chunk
Scorer = Callable[[pd.Series, pd.Series], tuple[Iterable[list[float]], Iterable[list[float]]]]


def chunk_starts(n: Column, length: Column, stride: Column | int) -> Column:
    """0, stride, … up to the first chunk that reaches the end; none for no word."""
    steps = F.ceil(F.greatest(n - length, F.lit(0)) / F.lit(stride)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), steps), lambda i: i * stride)).otherwise(
        F.array().cast("array<int>"))


def chunk_words(text: ColumnLike, length: Column | int, stride: int) -> Column:
    """``[{start, words}]``: overlapping runs of blank-separated words."""
    size = F.lit(length) if isinstance(length, int) else length
    return let(tokens(text), lambda w: let(F.size(w), lambda n: F.transform(
        chunk_starts(n, size, stride),
        lambda i: F.struct(i.alias("start"), F.slice(w, i + 1, size).alias("words")))))


def chunk_contexts(df: DataFrame, text: str = "context", length: Column | int = 384,
                   stride: int = 128) -> DataFrame:
    """One row per chunk: the input columns without the text, ``chunk, start, words``."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(chunk_words(text, length, stride)).alias("chunk", "_c")).select(
        *rest, "chunk", "_c.start", "_c.words")


def room_for_context(question: ColumnLike, max_seq_length: int = 512, max_query_length: int = 64,
                     marks: int = 3) -> Column:
    """Words left for the context beside the (cut) question and the marker words."""
    if max_seq_length - marks - max_query_length <= 0:
        raise ValueError("max_query_length leaves no room for the context")
    return F.lit(max_seq_length - marks) - F.least(F.size(tokens(question)), F.lit(max_query_length))


def word_span(context: ColumnLike, answer: ColumnLike, answer_start: ColumnLike) -> Column:
    """``{first, last}`` word of an answer given by its character offset."""
    c, a, s = col(context), col(answer), col(answer_start).cast("int")
    at = lambda upto: F.size(tokens(F.left(c, upto))) - 1
    return F.struct(at(s + 1).alias("first"), at(s + F.length(a)).alias("last"))


def chunk_answer_spans(df: DataFrame, length: Column | int = 384, stride: int = 128) -> DataFrame:
    """Chunks with the answer's position in them, null where it is not inside.

    ``df`` has ``context, answer, answer_start``; the rest passes through.
    """
    located = df.withColumn("_span", word_span("context", "answer", "answer_start"))
    chunks = chunk_contexts(located, "context", length, stride)
    first, last = F.col("_span.first") - F.col("start"), F.col("_span.last") - F.col("start")
    inside = (first >= 0) & (last < F.size("words"))
    return chunks.withColumns({
        "start_position": F.when(inside, first), "end_position": F.when(inside, last),
    }).drop("_span")


def score_chunks(chunks: DataFrame, scorer: Scorer) -> DataFrame:
    """Run an injected scorer over chunk rows, ``SCORED`` at a time.

    ``chunks`` has ``question`` and ``words``; adds ``start_logits, end_logits``.
    Only these two columns go to Python, and only the scores come back.
    """
    def scored(question: pa.Array, words: pa.Array) -> pa.Array:
        asked = pd.Series([(q or "").split() for q in question.to_pylist()], dtype=object)
        found = scorer(asked, pd.Series([w or [] for w in words.to_pylist()], dtype=object))
        return pa.StructArray.from_arrays([pa.array(list(x), pa.list_(pa.float64())) for x in found],
                                          ["start_logits", "end_logits"])

    @F.arrow_udf("start_logits array<double>, end_logits array<double>")
    def run(question: pa.Array, words: pa.Array) -> pa.Array:
        return pa.concat_arrays([scored(question.slice(at, SCORED), words.slice(at, SCORED))
                                 for at in range(0, max(len(words), 1), SCORED)])

    return chunks.withColumn("_scores", run("question", "words")).select(*chunks.columns, "_scores.*")


def feature_spans(start_logits: ColumnLike, end_logits: ColumnLike, n_best: int = 20,
                  max_answer_length: int = 30, first: int = 0) -> Column:
    """Best ``n_best`` spans of one feature as ``[{score, start, end}]``, from slot ``first`` on.

    Pairs only the ``n_best`` best starts with the ``n_best`` best ends, a fixed
    number of candidates per row whatever the length of the text. Equal scores
    prefer the earlier position.
    """
    def top(scores: Column) -> Column:
        ranked = F.sort_array(F.transform(scores, lambda v, i: F.struct((-v).alias("s"), i.alias("i"))))
        return F.slice(ranked, 1, n_best)

    def pair(starts: Column, ends: Column) -> Column:
        pairs = F.flatten(F.transform(starts, lambda s: F.transform(ends, lambda e: F.struct(
            (s["s"] + e["s"]).alias("cost"), s["i"].alias("start"), e["i"].alias("end")))))
        fits = F.filter(pairs, lambda p: (p["start"] >= first) & (p["end"] >= p["start"]) & (
            p["end"] - p["start"] + 1 <= max_answer_length))
        return F.transform(F.slice(F.sort_array(fits), 1, n_best), lambda p: F.struct(
            (-p["cost"]).alias("score"), p["start"].alias("start"), p["end"].alias("end")))

    return let(top(col(start_logits)), lambda s: let(top(col(end_logits)), lambda e: pair(s, e)))


def nbest_spans(features: DataFrame, key: str = "id", n_best: int = 20, max_answer_length: int = 30,
                keep: tuple[str, ...] = (), first: int = 0) -> DataFrame:
    """``key, rank, score, start, end, probability``: the best spans per question.

    Each feature contributes at most ``n_best`` spans and the rank filter also
    limits groups before the shuffle, so a question with very many chunks stays
    cheap. The softmax runs over the kept spans. Columns named in ``keep`` pass
    through and break ties between features.
    """
    spans = features.select(key, *keep, F.explode(
        feature_spans("start_logits", "end_logits", n_best, max_answer_length, first)).alias("s")).select(
        key, *keep, "s.*")
    best = Window.partitionBy(key).orderBy(F.desc("score"), *keep, "start", "end")
    ranked = spans.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_best)
    return _with_probability(ranked, key)


def _with_probability(ranked: DataFrame, key: str) -> DataFrame:
    """The softmax of the scores of a key; a missing score counts as 0."""
    group = Window.partitionBy(key)
    score = F.coalesce("score", F.lit(0.0))
    weighed = ranked.withColumn("_weight", F.exp(score - F.max(score).over(group)))
    return weighed.withColumn("probability", F.col("_weight") / F.sum("_weight").over(group)).drop("_weight")


def null_scores(features: DataFrame, key: str = "id") -> DataFrame:
    """``key, null_score``: the least score of slot 0, which stands for no answer, over a question's features."""
    score = F.get("start_logits", F.lit(0)) + F.get("end_logits", F.lit(0))
    return features.groupBy(key).agg(F.min(score).alias("null_score"))


def with_null_answer(ranked: DataFrame, nulls: DataFrame, key: str = "id", n_best: int = 20) -> DataFrame:
    """The n-best lists with the null answer: an empty ``text`` without ``start`` and ``end``.

    It stands where its score puts it, behind the spans of equal score, and last
    if that is beyond the ``n_best`` entries; a question without a span has it alone.
    ``ranked`` holds at most ``n_best`` spans of a question.
    """
    spans = ranked.drop("rank", "probability").withColumn("_null", F.lit(False))
    if "text" not in ranked.columns:
        spans = spans.withColumn("text", F.concat_ws("-", "start", "end"))
    empty = nulls.select(key, F.col("null_score").alias("score"), F.lit("").alias("text"), F.lit(True).alias("_null"))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "_null", "start", "end")
    placed = spans.unionByName(empty, allowMissingColumns=True).withColumn("rank", F.row_number().over(best))
    kept = placed.where(F.col("_null") | (F.col("rank") <= n_best))
    return _with_probability(kept.withColumn("rank", F.least("rank", F.lit(n_best + 1))).drop("_null"), key)


def null_odds(ranked: DataFrame, nulls: DataFrame, key: str = "id") -> DataFrame:
    """``key, odds``: the null score less the best span's, or less 0 without a span."""
    best = ranked.where((F.col("rank") == 1) & F.col("start").isNotNull()).select(key, F.col("score").alias("_best"))
    return nulls.join(best, key, "left").select(
        key, (F.col("null_score") - F.coalesce("_best", F.lit(0.0))).alias("odds"))


def answers_by_question(ranked: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, answer[], probability[]`` in rank order; at most ``n_best`` entries each."""
    listed = F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("answer"), "probability")))
    return ranked.groupBy(key).agg(listed.alias("_l")).select(
        key, F.transform("_l", lambda x: x["answer"]).alias("answer"),
        F.transform("_l", lambda x: x["probability"]).alias("probability"))


def attach_results(results: DataFrame, features: DataFrame, examples: DataFrame) -> DataFrame:
    """Results by feature_id, features by example_id: equi-joins Spark sizes itself."""
    return results.join(features, "feature_id").join(examples, "example_id")


def answer_questions(df: DataFrame, scorer: Scorer, n_best: int = 20, max_answer_length: int = 30,
                     max_seq_length: int = 512, doc_stride: int = 128,
                     max_query_length: int = 64) -> DataFrame:
    """Chunk, score and rank: ``id, question, context`` to the ranked answers per id.

    The scorer sees the first ``max_query_length`` words of a question. A question
    without any span, say of a blank context, has one empty answer without score.
    """
    room = room_for_context("question", max_seq_length, max_query_length)
    cut = F.array_join(F.slice(tokens("question"), 1, max_query_length), " ")
    chunks = chunk_contexts(df.select("id", cut.alias("question"), "context"), "context", room, doc_stride)
    scored = score_chunks(chunks, scorer)
    # Take the text out of the chunk before the words are dropped.
    spans = scored.select("id", "chunk", F.col("start").alias("offset"), "words", F.explode(
        feature_spans("start_logits", "end_logits", n_best, max_answer_length)).alias("s")).select(
        "id", "chunk", F.col("s.score").alias("score"),
        (F.col("offset") + F.col("s.start")).alias("start"), (F.col("offset") + F.col("s.end")).alias("end"),
        F.array_join(F.slice("words", F.col("s.start") + 1, F.col("s.end") - F.col("s.start") + 1), " ")
        .alias("text"))
    # An entry behind all spans, for questions that have none.
    entries = spans.unionByName(df.select("id", F.lit("").alias("text")), allowMissingColumns=True)
    best = Window.partitionBy("id").orderBy(F.desc_nulls_last("score"), "start", "end", "chunk")
    ranked = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_best)
    ranked = ranked.where(F.col("score").isNotNull() | (F.col("rank") == 1))
    return _with_probability(ranked, "id").select("id", "rank", "score", "start", "end", "text", "probability")


def best_predictions(ranked: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """``id, prediction``: the first answer of each question.

    With ``questions``, those without any span get an empty answer.
    """
    first = ranked.where(F.col("rank") == 1).select("id", F.col("text").alias("prediction"))
    if questions is None:
        return first
    return questions.select("id").distinct().join(first, "id", "left").select(
        "id", F.coalesce("prediction", F.lit("")).alias("prediction"))
