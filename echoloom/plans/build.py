"""From question records and recognition results to nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import content_id, is_blank, py_strip, simple_normalizer
from echoloom.operators import contexts, qa, speech
from echoloom.operators.normalize import Normalizer, normalize_field
from echoloom.session import materialize
from echoloom.sinks import files as sinks


def prepare(records: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The dictionary of all distinct contexts, and the questions by context id.

    The dictionary covers every split and its ids are a function of the text, so
    replacing a text needs no lookup and no shuffle; ``replace_contexts`` serves
    dictionaries made elsewhere.
    """
    dictionary = contexts.distinct_contexts(records, order)
    filled = ~is_blank("context")
    questions = records.withColumns({
        "context_id": F.when(filled, content_id(py_strip("context"))),
        "context": F.when(~filled, F.col("context")),
    })
    return dictionary, questions


def plan_synthesis(questions: DataFrame, dictionary: DataFrame, voices: DataFrame, limit: int | None = None,
                   seed: int | str = 0) -> DataFrame:
    """What to synthesise: each requested context with a file name and a voice."""
    known = contexts.last_wins(dictionary, "context_id", "context", "first_seen")
    wanted = contexts.limit_contexts(contexts.contexts_to_process(questions, known), limit)
    return speech.synthesis_metadata(wanted, voices, seed)


def transcripts(responses: DataFrame, order: str, normalizer: Normalizer = simple_normalizer) -> DataFrame:
    """Normalised transcript lines of recognition results."""
    lines = responses.transform(speech.flatten_hypotheses).transform(
        speech.transcript_lines, keep=(order, "file_name", "processing_time"))
    return normalize_field(lines, "context", normalizer)


def merge(questions: DataFrame, lines: DataFrame, order: str) -> DataFrame:
    """Questions with their transcripts, stored for the passes of nesting."""
    return materialize(qa.merge_transcripts(questions, lines, order), "merged")


def documents(merged: DataFrame, order: str, split: str | None = None) -> DataFrame:
    """The placed questions of one split, or of all records."""
    chosen = merged if split is None else merged.where(F.col("split") == split)
    return qa.nest(chosen, order)


def build(records: DataFrame, responses: DataFrame, order: str, response_order: str,
          normalizer: Normalizer = simple_normalizer) -> DataFrame:
    """The whole chain up to the questions of nested documents."""
    _, questions = prepare(records, order)
    lines = transcripts(responses, response_order, normalizer)
    return documents(merge(questions, lines, response_order), order)


def export(merged: DataFrame, order: str, path: str, splits: tuple[str, ...], version: str = "v1.0",
           layout: str = "document") -> None:
    """One nested document dataset per split below ``path``."""
    for split in splits:
        sinks.write_qa_documents(documents(merged, order, split), f"{path}/{split}", version, layout)
