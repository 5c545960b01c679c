"""Question records: merge transcripts, pair answers, find their places in documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, col
from echoloom.operators.contexts import last_wins
from echoloom.operators.spread import lookup_join

ANSWER = "array<struct<text:string,answer_start:bigint>>"
PLACED = ("title_at", "paragraph_at", "at", "title", "context", "id", "question", "answers")


def merge_transcripts(questions: DataFrame, transcripts: DataFrame, order: str,
                      hot_rows: int = 1_000_000) -> DataFrame:
    """Put the last transcript of each id in place of the question's context.

    Error lines have no text and never match; an empty transcript does match.
    Questions without a transcript keep the context they have.
    """
    latest = last_wins(transcripts.select("context_id", "context", order), "context_id", "context", order)
    joined = lookup_join(questions, latest.withColumnRenamed("context", "_transcript"), "context_id",
                         hot_rows=hot_rows)
    kept = F.col("context") if "context" in questions.columns else F.lit(None).cast("string")
    rest = [c for c in questions.columns if c != "context"]
    return joined.select(*rest, F.coalesce("_transcript", kept).alias("context"))


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count("*").alias("questions"), F.count("context").alias("with_context"))


def zip_answers(answers: ColumnLike) -> Column:
    """``[{text, answer_start}]`` if both lists have equal length, without empty texts."""
    a = col(answers)
    texts, starts = a.getField("text"), a.getField("answer_start")
    pairs = F.zip_with(texts, starts, lambda t, s: F.struct(t.alias("text"), s.cast("bigint").alias("answer_start")))
    paired = F.when(F.size(texts) == F.size(starts), F.filter(pairs, lambda p: p.getField("text") != ""))
    return F.coalesce(paired, F.array().cast(ANSWER))


def identity(df: DataFrame, keys: str | None = None) -> DataFrame:
    """Fill in default id, title, question and context.

    Null counts as absent, unless ``keys`` names a column with the keys each
    record has; then a key given as null stays null.
    """
    def given(name: str, default: Column) -> Column:
        if keys is None:
            return F.coalesce(F.col(name), default)
        return F.when(F.array_contains(F.col(keys), name), F.col(name)).otherwise(default)

    return df.withColumns({
        "id": given("id", given("uit_id", F.lit("unknown"))),
        "title": given("title", F.lit("Untitled")),
        "question": given("question", F.lit("")),
        "context": F.coalesce("context", F.lit("")),
    })


def answerable(df: DataFrame, keys: str | None = None) -> DataFrame:
    """Questions that reach a document: a context and at least one usable answer.

    Dropping the others before the grouping means that no empty paragraph or
    title ever forms.
    """
    return (identity(df, keys).where(F.col("context") != "")
            .withColumn("answers", zip_answers("answers")).where(F.size("answers") > 0))


def place(entries: DataFrame) -> DataFrame:
    """Add ``title_at`` and ``paragraph_at``, the first ``at`` of each row's title and paragraph.

    ``at`` is a unique integer. Equal titles are one title, equal contexts of a
    title one paragraph. Texts are compared by digest; the places of paragraphs
    form a table of numbers, joined back to the rows.
    """
    digest = lambda *c: F.sha2(F.to_json(F.struct(*c)), 256)
    marked = entries.withColumns({"_title": digest("title"), "_paragraph": digest("title", "context")})
    paragraphs = marked.groupBy("_title", "_paragraph").agg(F.min("at").alias("paragraph_at"))
    titles = paragraphs.groupBy("_title").agg(F.min("paragraph_at").alias("title_at"))
    places = lookup_join(paragraphs, titles, "_title").drop("_title")
    return lookup_join(marked.drop("_title"), places, "_paragraph").drop("_paragraph")


def nest(df: DataFrame, order: str, keys: str | None = None) -> DataFrame:
    """The questions of a document and where they stand in it, one row each.

    ``title_at, paragraph_at, at, title, context, id, question, answers``; titles,
    paragraphs and questions keep first-seen order, that of these numbers.
    ``order`` is a unique integer. Text is nested only where a file is written,
    so no title or paragraph is ever one row, whatever its size.
    """
    rows = answerable(df, keys).select(F.col(order).cast("bigint").alias("at"), "title", "context", "id", "question",
                                       "answers")
    return place(rows).select(*PLACED)


def _entries(documents: DataFrame) -> DataFrame:
    """Questions with places, of ``nest`` or of documents that were read.

    An empty paragraph or title of a read document is a row with a null question
    (``asked`` is false). Questions that name no place count in the order of the scan.
    """
    if "paragraphs" not in documents.columns:
        return documents.withColumn("asked", F.lit(True))
    paragraphs = documents.select("title", F.explode_outer("paragraphs").alias("p"))
    rows = paragraphs.select("title", "p.context", F.explode_outer("p.qas").alias("q"))
    at = F.monotonically_increasing_id()
    if "at" in rows.schema["q"].dataType.names:
        at = F.coalesce("q.at", at)
    return place(rows.select(at.alias("at"), "title", "context", "q.id", "q.question", "q.answers",
                             F.col("q").isNotNull().alias("asked")))


def document_stats(documents: DataFrame) -> DataFrame:
    """Titles, paragraphs and questions: the first row of a title or paragraph stands at its place."""
    return _entries(documents).agg(
        F.count_if(F.col("at") == F.col("title_at")).alias("titles"),
        F.count_if((F.col("at") == F.col("paragraph_at")) & F.col("context").isNotNull()).alias("paragraphs"),
        F.count_if("asked").alias("questions"))


def flatten_documents(documents: DataFrame) -> DataFrame:
    """One row per question of every paragraph: ``title, context, id, question, answers``."""
    columns = ("title", "context", "id", "question", "answers")
    if "paragraphs" not in documents.columns:
        return documents.select(*columns)
    paragraphs = documents.select("title", F.explode("paragraphs").alias("p"))
    return paragraphs.select("title", "p.context", F.explode("p.qas").alias("q")).select(
        "title", "context", "q.id", "q.question", "q.answers")


def to_examples(documents: DataFrame) -> DataFrame:
    """The questions of the first paragraph of each title, all answerable, one row each."""
    first = _entries(documents).where(F.col("asked") & (F.col("paragraph_at") == F.col("title_at")))
    return first.select(*PLACED, F.lit(False).alias("is_impossible"))


def trim_null_answer(df: DataFrame) -> DataFrame:
    """Drop the last entry, the null answer, of ``answer`` and ``probability``."""
    shorter = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))
    return df.withColumns({c: shorter(F.col(c)) for c in ("answer", "probability")})
