"""Scores of predictions against ground truth."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.scores import best_scores, verdict
from echoloom.operators.spread import lookup_join, pick_rows
from echoloom.session import materialize

# (true answer, predicted answer) -> aggregate over all questions.
SetMetric = Callable[[Column, Column], Column]


def truths(df: DataFrame) -> DataFrame:
    """``id, truths`` from question rows with an ``answers`` array of structs."""
    return df.select("id", F.transform("answers", lambda a: a["text"]).alias("truths"))


def last_rows(df: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """The last row of each key, null being a key, by ``order``, or in the order of the scan where ``df`` is one.

    Behind a shuffle rows have no order of their own: name a column of the source then (``spread.number_rows``).
    """
    if order is not None:
        return pick_rows(df, key, order)
    rest = [c for c in df.columns if c != key]
    placed = df.select(key, F.struct(*rest).alias("_row"), F.monotonically_increasing_id().alias("_place"))
    return placed.groupBy(key).agg(F.max_by("_row", "_place").alias("_row")).select(key, "_row.*").select(*df.columns)


def question_scores(truth: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """``id, answered, exact_match, f1``: best over the truths, 0 if unanswered.

    Of several questions, or predictions, with one id the last counts, by
    ``order`` (a column of both) or in the order of the scan. The words are compared within the row. A question
    that is answered but has no truth gets null scores.
    """
    said = last_rows(predictions, order=order).select("id", "prediction")
    joined = lookup_join(last_rows(truth, order=order), said, "id")
    answered = F.col("prediction").isNotNull()
    scored = joined.select("id", answered.alias("answered"),
                           F.when(answered, best_scores("prediction", "truths")).alias("_s"))
    return scored.select("id", "answered", *[
        F.when(F.col("answered"), F.col("_s")[c]).otherwise(F.lit(0.0)).alias(c) for c in ("exact_match", "f1")])


def em_f1(scores: DataFrame) -> DataFrame:
    """Mean scores in percent over all questions; null for no question."""
    scored = F.count("f1")
    return scores.agg(
        F.count("*").alias("questions"),
        F.count_if("answered").alias("answered"),
        F.count_if(F.col("f1").isNull()).alias("rejected"),
        F.try_divide(100.0 * F.sum("exact_match"), scored).alias("exact_match"),
        F.try_divide(100.0 * F.sum("f1"), scored).alias("f1"),
    )


def first_truths(df: DataFrame, *kept: str) -> DataFrame:
    """``id, truth`` with the first answer, empty text if there is none; and the columns ``kept``."""
    first = F.get("answers", F.lit(0))["text"]
    return df.select("id", F.coalesce(first, F.lit("")).alias("truth"),
                     *[c for c in ("question",) if c in df.columns], *kept)


def strict_prediction_join(truth: DataFrame, predictions: DataFrame, order: str | None = None) -> DataFrame:
    """Truth with its prediction; the job fails on the first id without one.

    The check is part of the join's projection, so it costs no second pass. Of
    several truths, or predictions, with one id the last counts, by ``order`` (a
    column of both) or in the order of the scan.
    """
    said = last_rows(predictions, order=order).select("id", "prediction")
    joined = lookup_join(last_rows(truth, order=order), said, "id")
    missing = F.raise_error(F.concat(F.lit("no prediction for question "), F.coalesce("id", F.lit("null"))))
    return joined.withColumn("prediction", F.coalesce("prediction", missing.cast("string")))


def verdicts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("verdict", verdict("prediction", "truth"))


def verdict_counts(judged: DataFrame, **metrics: SetMetric) -> DataFrame:
    """correct / similar / incorrect, and any further metric over the whole set.

    A metric returns an aggregate expression, so it combines on the map side and
    no task ever holds the whole list of answers.
    """
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "similar", "incorrect")]
    extra = [build(F.col("truth"), F.col("prediction")).alias(name) for name, build in metrics.items()]
    return judged.agg(*counts, *extra)


class WholeSetMetric(Protocol):
    """A metric over all answers that is no aggregate expression. Its state must stay small, whatever it has seen."""

    def zero(self) -> Any:
        """The state before any answer."""

    def update(self, state: Any, truth: pd.Series, prediction: pd.Series) -> Any:
        """The state after a batch of answers."""

    def merge(self, one: Any, other: Any) -> Any:
        """The state after the answers of both; which comes first must not matter."""

    def finish(self, state: Any) -> float:
        """The metric."""


# States that one task merges.
MERGE_STATES = 64


def whole_set_metric(pairs: DataFrame, metric: WholeSetMetric, name: str = "value") -> DataFrame:
    """One row with the metric over all ``truth, prediction`` rows.

    Each task folds what it reads into one state; states are merged ``MERGE_STATES`` at a time, level by level, so no
    task sees all answers, nor all states.
    """
    def fold(batches):
        from pyspark import TaskContext

        state = metric.zero()
        for batch in batches:
            state = metric.update(state, batch["truth"], batch["prediction"])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(s) for s in rows["state"]]
        whole = states[0]
        for state in states[1:]:
            whole = metric.merge(whole, state)
        return pd.DataFrame({"part": [rows["part"].iloc[0] // MERGE_STATES], "state": [pickle.dumps(whole)]})

    schema = "part bigint, state binary"
    folded = pairs.select("truth", "prediction").mapInPandas(fold, schema)
    # A state of no answers: a table without tasks has a metric too.
    none = pairs.sparkSession.createDataFrame([(0, bytearray(pickle.dumps(metric.zero())))], schema)
    states = materialize(folded.unionByName(none), "metric-states")
    last = states.agg(F.max("part")).first()[0]
    while True:
        group = F.floor(F.col("part") / F.lit(MERGE_STATES)).alias("group")
        states = states.groupBy(group).applyInPandas(merge, schema)
        last //= MERGE_STATES
        if not last:
            break

    @F.pandas_udf("double")
    def finish(state: pd.Series) -> pd.Series:
        return state.map(lambda s: metric.finish(pickle.loads(s)))

    return states.select(finish("state").alias(name))
