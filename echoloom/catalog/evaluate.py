"""Exact match, token F1, verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions import scores
from echoloom.operators import evaluate as ops


def _truths(spark, sf):
    kept = F.filter("answers.text", lambda t: t != "")
    return fx.qa(spark, sf).select(F.col("uit_id").alias("id"), kept.alias("truths"), "ord")


def _scores(spark, sf):
    return ops.question_scores(_truths(spark, sf), fx.predictions(spark, sf), order="ord")


def per_question_scores(spark, sf):
    return _scores(spark, sf).withColumn("f1", F.round("f1", 9))


def em_f1(spark, sf):
    report = ops.em_f1(_scores(spark, sf))
    return report.withColumns({c: F.round(c, 6) for c in ("exact_match", "f1")})


def token_f1(spark, sf):
    """Whole texts against each other: every question with its context."""
    return fx.qa(spark, sf).select("uit_id", F.round(scores.token_f1("question", "context"), 9).alias("f1"))


def exact_match(spark, sf):
    both = fx.qa(spark, sf).select(F.col("uit_id").alias("id"), "a1").join(fx.predictions(spark, sf), "id")
    return both.select("id", scores.exact_match("prediction", "a1").alias("exact_match"))


def _pairs(spark, sf):
    """Every question with its first answer; a missing prediction is an empty one."""
    truth = fx.qa(spark, sf).select(F.col("uit_id").alias("id"), F.transform(
        "answers.text", lambda t: F.struct(t.alias("text"))).alias("answers"), "ord").transform(
            ops.first_truths, "ord")
    return ops.strict_prediction_join(truth, fx.predictions(spark, sf, missing=""), order="ord")


def strict_prediction_join(spark, sf):
    return _pairs(spark, sf).select("id", "truth", "prediction")


def verdicts(spark, sf):
    return ops.verdicts(_pairs(spark, sf)).select("id", "verdict")


def verdict_counts(spark, sf):
    return ops.verdict_counts(ops.verdicts(_pairs(spark, sf)))


def extra_metrics(spark, sf):
    report = ops.verdict_counts(
        ops.verdicts(_pairs(spark, sf)),
        answered_share=lambda truth, prediction: F.round(F.avg((prediction != "").cast("double")), 6),
        length_gap=lambda truth, prediction: F.round(F.avg(F.abs(F.length(truth) - F.length(prediction))), 6))
    return report


LONGEST = 4095


class LengthDistance:
    """Largest difference between the shares of truths and of predictions up to a length (Kolmogorov-Smirnov)."""

    def zero(self):
        return np.zeros((2, LONGEST + 1), np.int64)

    def update(self, state, truth, prediction):
        for row, texts in zip(state, (truth, prediction)):
            row += np.bincount(texts.str.len().clip(upper=LONGEST), minlength=LONGEST + 1)
        return state

    def merge(self, one, other):
        return one + other

    def finish(self, state):
        shares = state.cumsum(axis=1) / np.maximum(state.sum(axis=1, keepdims=True), 1)
        return float(np.abs(shares[0] - shares[1]).max())


def whole_set_metric(spark, sf):
    distance = ops.whole_set_metric(_pairs(spark, sf), LengthDistance(), "distance")
    return distance.withColumn("distance", F.round("distance", 9))


QUERIES = {
    "whole_set_metric": whole_set_metric,
    "em_f1": em_f1, "per_question_scores": per_question_scores, "token_f1": token_f1,
    "exact_match": exact_match, "strict_prediction_join": strict_prediction_join,
    "verdicts": verdicts, "verdict_counts": verdict_counts, "extra_metrics": extra_metrics,
}


def _f1_ctes(pairs: str) -> dict[str, str]:
    """Token overlap as a join of word counts, over ``pairs(k, p, t)`` with unique k."""
    return {
        "pairs": pairs,
        "norms": f"select k, {fx.answer_words_sql('p')} as pw, {fx.answer_words_sql('t')} as tw from pairs",
        "pc": "select k, w, count(*) as n from (select k, unnest(pw) as w from norms) group by k, w",
        "tc": "select k, w, count(*) as n from (select k, unnest(tw) as w from norms) group by k, w",
        "same": "select pc.k, sum(least(pc.n, tc.n))::double as n from pc join tc on pc.k = tc.k and pc.w = tc.w "
                "group by pc.k",
        "f1s": "select norms.k, pw, tw, case when same.n is null then 0.0::double else "
               "2 * (same.n / len(pw)) * (same.n / len(tw)) / ((same.n / len(pw)) + (same.n / len(tw))) end as f1 "
               "from norms left join same on norms.k = same.k",
    }


_TRUTHS = """
select q.uit_id, p.prediction, unnest(list_filter([a1, a2], lambda a: a <> '')) as t,
  unnest(list_filter([1, 2], lambda i: [a1, a2][i] <> '')) as i
from f_qa q join f_predictions p on q.uit_id = p.id"""
_SCORES = """
select q.uit_id as id, b.em is not null as answered, coalesce(b.em, 0.0::double) as exact_match,
  coalesce(b.f1, 0.0::double) as f1
from f_qa q left join (
  select split_part(k, '#', 1) as id, max(f1) as f1,
    max(case when array_to_string(pw, ' ') = array_to_string(tw, ' ') then 1.0::double else 0.0::double end) as em
  from f1s group by 1) b on q.uit_id = b.id"""
SCORED = {"truths": _TRUTHS, **_f1_ctes("select uit_id || '#' || i as k, prediction as p, t from truths"),
           "scores": _SCORES}
_PAIRS = """
select q.uit_id as id, a1 as truth, coalesce(p.prediction, '') as prediction
from f_qa q left join f_predictions p on q.uit_id = p.id"""
_JUDGED = f"""
select *, case when p = t then 'correct' when contains(t, p) or contains(p, t) then 'similar' else 'incorrect' end
  as verdict
from (select *, {fx.strip_sql('truth')} as t, {fx.strip_sql('prediction')} as p from pairs)"""
COUNTS = ", ".join(f"count(*) filter (verdict = '{v}') as {v}" for v in ("correct", "similar", "incorrect"))

ORACLE = {
    "em_f1": fx.sql("""
select count(*) as questions, count(*) filter (answered) as answered, 0::bigint as rejected,
  round(100.0 * sum(exact_match) / count(*), 6) as exact_match, round(100.0 * sum(f1) / count(*), 6) as f1
from scores""", "f_qa", "f_predictions", **SCORED),
    "per_question_scores": fx.sql("select id, answered, exact_match, round(f1, 9) as f1 from scores",
                                  "f_qa", "f_predictions", **SCORED),
    "token_f1": fx.sql("select k as uit_id, round(f1, 9) as f1 from f1s", "f_qa",
                       **_f1_ctes("select uit_id as k, question as p, context as t from f_qa")),
    "exact_match": fx.sql(f"""
select p.id, {fx.normal_sql('p.prediction')} = {fx.normal_sql('q.a1')} as exact_match
from f_qa q join f_predictions p on q.uit_id = p.id""", "f_qa", "f_predictions"),
    "strict_prediction_join": fx.sql("select id, truth, prediction from pairs", "f_qa", "f_predictions", pairs=_PAIRS),
    "verdicts": fx.sql("select id, verdict from judged", "f_qa", "f_predictions", pairs=_PAIRS, judged=_JUDGED),
    "verdict_counts": fx.sql(f"select {COUNTS} from judged", "f_qa", "f_predictions",
                             pairs=_PAIRS, judged=_JUDGED),
    "extra_metrics": fx.sql(f"""
select {COUNTS}, round(avg(case when prediction <> '' then 1.0::double else 0.0::double end), 6) as answered_share,
  round(avg(abs(length(truth) - length(prediction))), 6) as length_gap from judged""",
                            "f_qa", "f_predictions", pairs=_PAIRS, judged=_JUDGED),
}

ORACLE["whole_set_metric"] = fx.sql(f"""
select round(max(abs(t - p)), 9) as distance from (
  select sum(t) over (order by n) / sum(t) over () as t, sum(p) over (order by n) / sum(p) over () as p from (
    select n, sum(t)::double as t, sum(p)::double as p from (
      select least(length(truth), {LONGEST}) as n, 1 as t, 0 as p from pairs
      union all select least(length(prediction), {LONGEST}), 0, 1 from pairs) group by n))""",
                                    "f_qa", "f_predictions", pairs=_PAIRS)
