"""From nested documents to predictions and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from echoloom.operators import evaluate as ops
from echoloom.operators import qa, scoring


def questions(documents: DataFrame) -> DataFrame:
    """``id, question, context`` of each title's first paragraph."""
    return qa.to_examples(documents).select("id", "question", "context")


def predict(documents: DataFrame, scorer: scoring.Scorer, **knobs: int) -> DataFrame:
    """Ranked answers to the questions of each title's first paragraph."""
    return scoring.answer_questions(questions(documents), scorer, **knobs)


def report(documents: DataFrame, predictions: DataFrame) -> DataFrame:
    """Exact match and F1 over the questions of all paragraphs."""
    truth = ops.truths(qa.flatten_documents(documents))
    return ops.em_f1(ops.question_scores(truth, predictions))


def judge(documents: DataFrame, predictions: DataFrame, **metrics: ops.SetMetric) -> DataFrame:
    """correct / similar / incorrect counts; every question needs a prediction."""
    truth = ops.first_truths(qa.flatten_documents(documents))
    return ops.verdict_counts(ops.verdicts(ops.strict_prediction_join(truth, predictions)), **metrics)
