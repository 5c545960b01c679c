"""Answer scores as expressions over one row; no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, answer_tokens, col, let, normalize_answer, py_strip

Metric = Callable[[Column, Column], Column]


def numbered(words: Column) -> Column:
    """Mark each word with its occurrence number, e.g. ``a 1, a 2, b 1``.

    Two multisets then overlap exactly where the marked sets do. Sorting and a
    hash intersection keep this O(k log k), so whole documents score as well
    as short answers.
    """
    def runs(s: Column) -> Column:
        positions = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(
            F.array().cast("array<int>"))
        starts = F.filter(positions, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

        def mark(b: Column) -> Column:
            return F.flatten(F.transform(b, lambda at, j: F.transform(
                F.sequence(F.lit(1), F.coalesce(F.get(b, j + 1), F.size(s)) - at),
                lambda o: F.concat(F.get(s, at), F.lit(" "), o.cast("string")))))

        return let(starts, mark)

    return let(F.sort_array(words), runs)


def _f1(p: Column, t: Column) -> Column:
    same = F.size(F.array_intersect(p, t)).cast("double")
    precision, recall = F.try_divide(same, F.size(p)), F.try_divide(same, F.size(t))
    return F.when(same == 0, F.lit(0.0)).otherwise(
        F.try_divide(2 * precision * recall, precision + recall))


def token_f1(prediction: ColumnLike, truth: ColumnLike) -> Column:
    """Harmonic mean of word precision and recall; 0 without a shared word."""
    return let(numbered(answer_tokens(prediction)), lambda p: let(
        numbered(answer_tokens(truth)), lambda t: _f1(p, t)))


def exact_match(prediction: ColumnLike, truth: ColumnLike) -> Column:
    return normalize_answer(prediction) == normalize_answer(truth)


def best_scores(prediction: ColumnLike, truths: ColumnLike) -> Column:
    """``{exact_match, f1}``: the best of each over the truths, null without a truth.

    Every text is split once for both scores.
    """
    def against(words: Column) -> Column:
        return let(numbered(words), lambda marked: F.transform(col(truths), lambda t: let(
            answer_tokens(t), lambda w: F.struct(
                (w == words).cast("double").alias("exact_match"), _f1(marked, numbered(w)).alias("f1")))))

    def best(each: Column) -> Column:
        return F.struct(*[F.array_max(each[f]).alias(f) for f in ("exact_match", "f1")])

    return let(let(answer_tokens(prediction), against), best)


def best_over(metric: Metric, prediction: ColumnLike, truths: ColumnLike) -> Column:
    """Maximum of any ``metric(prediction, truth)`` over the truths; null for none."""
    return let(col(prediction), lambda p: F.array_max(F.transform(
        col(truths), lambda t: metric(p, t).cast("double"))))


def verdict(prediction: ColumnLike, truth: ColumnLike) -> Column:
    """correct / similar / incorrect, case-sensitive, blanks at the ends ignored."""
    p, t = py_strip(prediction), py_strip(truth)
    return (F.when(p == t, "correct").when(F.contains(t, p) | F.contains(p, t), "similar")
            .otherwise("incorrect"))
