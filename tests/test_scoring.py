import math
import random

import pytest
from pyspark.sql import functions as F

from echoloom.catalog.scoring import lexical_scorer, lexical_scores
from echoloom.operators import evaluate, scoring


def chunks_of(words, length, stride):
    out, at = [], 0
    while words:
        out.append((at, words[at:at + length]))
        if at + length >= len(words):
            break
        at += stride
    return out


@pytest.mark.parametrize("length,stride", [(5, 2), (5, 5), (3, 1), (100, 7), (4, 9)])
def test_chunks(spark, length, stride):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (0, 1, 4, 5, 6, 7, 11, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, context string")
    got = {}
    for r in scoring.chunk_contexts(df, length=length, stride=stride).orderBy("n", "chunk").collect():
        got.setdefault(r.n, []).append((r.start, list(r.words)))
    assert got == {n: c for n, t in enumerate(texts) if (c := chunks_of(t.split(), length, stride))}


def test_answer_spans(spark):
    context = "aa bb  cc dd ee ff gg"
    df = spark.createDataFrame([(context, "cc dd", context.index("cc")), (context, "e f", 14), (context, "gg", 19)],
                               "context string, answer string, answer_start int")
    got = [(r.answer, r.chunk, r.start_position, r.end_position)
           for r in scoring.chunk_answer_spans(df, 4, 2).orderBy("answer", "chunk").collect()]
    assert got == [("cc dd", 0, 2, 3), ("cc dd", 1, 0, 1), ("cc dd", 2, None, None),
                   ("e f", 0, None, None), ("e f", 1, 2, 3), ("e f", 2, 0, 1),
                   ("gg", 0, None, None), ("gg", 1, None, None), ("gg", 2, 2, 2)]


def best_spans(features, n, longest):
    """All pairs of the n best starts and ends of each feature, by plain loops."""
    found = []
    for start, end in features:
        top = lambda v: sorted(range(len(v)), key=lambda i: (-v[i], i))[:n]
        pairs = [(start[i] + end[j], i, j) for i in top(start) for j in top(end) if 0 <= j - i < longest]
        found += sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:n]
    found = sorted(found, key=lambda p: (-p[0], p[1], p[2]))[:n]
    total = sum(math.exp(p[0] - found[0][0]) for p in found)
    return [(s, i, j, math.exp(s - found[0][0]) / total) for s, i, j in found]


def test_nbest(spark):
    rng = random.Random(5)
    data = {q: [([rng.randrange(-9, 9) / 4 for _ in range(m)], [rng.randrange(-9, 9) / 4 for _ in range(m)])
                for m in rng.sample(range(1, 30), 4)] for q in "abc"}
    df = spark.createDataFrame([(q, s, e) for q, fs in data.items() for s, e in fs],
                               "id string, start_logits array<double>, end_logits array<double>").repartition(3)
    got = {}
    for r in scoring.nbest_spans(df, "id", n_best=6, max_answer_length=5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.score, r.start, r.end, r.probability))
    for q, fs in data.items():
        want = best_spans(fs, 6, 5)
        assert [g[:3] for g in got[q]] == [w[:3] for w in want]
        assert [g[3] for g in got[q]] == pytest.approx([w[3] for w in want])


def test_answers_are_found(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(12):
        context = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        rows.append((f"q{i}", " ".join(rng.sample(words, 6)), " ".join(context)))
    df = spark.createDataFrame(rows, "id string, question string, context string")
    got = {}
    knobs = dict(n_best=3, max_answer_length=4, max_seq_length=30, doc_stride=10, max_query_length=8)
    for r in scoring.answer_questions(df, lexical_scorer, **knobs).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.score, r.start, r.end, r.text))
    for qid, question, context in rows:
        found = []
        for n, (at, part) in enumerate(chunks_of(context.split(), 30 - 3 - 6, 10)):
            s, e = lexical_scores(question.split()[:8], part)
            for score, i, j, _ in best_spans([(s, e)], 3, 4):
                found.append((score, at + i, at + j, n, " ".join(part[i:j + 1])))
        found = sorted(found, key=lambda p: (-p[0], p[1], p[2], p[3]))[:3]
        assert got[qid] == [(s, i, j, t) for s, i, j, _, t in found]


def test_long_questions_are_cut_and_blank_contexts_answered(spark):
    df = spark.createDataFrame([("long", "a b c d", "x d y"), ("blank", "a", " "), ("none", None, None)],
                               "id string, question string, context string")
    seen = lambda q, w: ([[float(len(x))] * len(c) for x, c in zip(q, w)], [[0.0] * len(c) for c in w])
    got = scoring.answer_questions(df, seen, n_best=2, max_seq_length=10, max_query_length=2).collect()
    assert {r.score for r in got if r.id == "long"} == {2.0} and sum(r.id == "long" for r in got) == 2
    rest = [tuple(r) for r in got if r.id != "long"]
    assert sorted(rest) == [(i, 1, None, None, None, "", 1.0) for i in ("blank", "none")]


def test_chunks_are_scored_in_pieces(spark):
    """However many chunks a batch has, the scorer holds a bounded number at once."""
    rows = [(i, f"q{i}" if i % 3 else None, ["w"] * (i % 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, question string, words array<string>").coalesce(1)
    held = lambda q, w: ([[float(len(q))] * len(x) for x in w], [[float(len(x))] * len(c) for x, c in zip(q, w)])
    got = {r.i: r for r in scoring.score_chunks(df, held).collect()}
    assert len(got) == 1000 and max(v for r in got.values() for v in r.start_logits) <= scoring.SCORED
    assert all(list(got[i].end_logits) == [1.0 if q else 0.0] * len(w) for i, q, w in rows)


@pytest.mark.parametrize("slot,rank", [(9.0, 1), (2.75, 2), (-50.0, 3)])
def test_null_answer(spark, slot, rank):
    features = spark.createDataFrame(
        [("q", [slot, 2.0, 1.0], [0.0, 1.0, 0.5]), ("q", [slot + 5, 0.0, 0.0], [0.0, 0.0, 0.0]), ("n", [slot], [1.0])],
        "id string, start_logits array<double>, end_logits array<double>")
    spans = scoring.nbest_spans(features, "id", n_best=2, first=1)
    nulls = scoring.null_scores(features)
    got = scoring.with_null_answer(spans, nulls, n_best=2).orderBy("id", "rank").collect()
    mine = [r for r in got if r.id == "q"]
    assert [r.rank for r in mine if r.text == ""] == [rank] and [r.rank for r in mine] == list(range(1, len(mine) + 1))
    assert len(mine) == (3 if rank == 3 else 2)
    assert sum(r.probability for r in mine) == pytest.approx(1)
    assert [(r.rank, r.text, r.score) for r in got if r.id == "n"] == [(1, "", slot + 1)]
    odds = {r.id: r.odds for r in scoring.null_odds(spans, nulls).collect()}
    assert odds == {"q": slot - 3.0, "n": slot + 1}


def test_no_room_for_context(spark):
    with pytest.raises(ValueError):
        scoring.room_for_context("q", max_seq_length=64, max_query_length=64)


def test_attach_results(spark):
    results = spark.createDataFrame([(1, 0.5), (2, 0.7)], "feature_id int, score double")
    features = spark.createDataFrame([(1, "e1"), (2, "e1")], "feature_id int, example_id string")
    examples = spark.createDataFrame([("e1", "Q")], "example_id string, question string")
    assert scoring.attach_results(results, features, examples).count() == 2


def test_em_f1_report(spark):
    truth = spark.createDataFrame([("a", ["x y"]), ("b", ["x"]), ("c", ["z"]), ("d", [])], "id string, truths array<string>")
    guess = spark.createDataFrame([("a", "X"), ("b", "x!"), ("d", "p")], "id string, prediction string")
    scored = evaluate.question_scores(truth, guess)
    report = evaluate.em_f1(scored).first()
    assert (report.questions, report.answered, report.rejected) == (4, 3, 1)
    assert report.exact_match == pytest.approx(100 / 3) and report.f1 == pytest.approx(100 * (2 / 3 + 1) / 3)
    empty = evaluate.em_f1(scored.where("false")).first()
    assert empty.questions == 0 and empty.f1 is None


def test_verdicts_and_metrics(spark):
    truth = spark.createDataFrame([("a", [("x ",)], "?"), ("b", [], "?"), ("c", [("xyz",)], "?"), ("d", [("q",)], "?")],
                                  "id string, answers array<struct<text:string>>, question string")
    guess = spark.createDataFrame([("a", "x"), ("b", "zz"), ("c", "y"), ("d", "w")], "id string, prediction string")
    judged = evaluate.verdicts(evaluate.strict_prediction_join(evaluate.first_truths(truth), guess))
    assert {r.id: r.verdict for r in judged.collect()} == {
        "a": "correct", "b": "similar", "c": "similar", "d": "incorrect"}
    report = evaluate.verdict_counts(judged, size=lambda t, p: F.sum(F.length(t) + F.length(p)))
    assert report.first().asDict() == {"correct": 1, "similar": 2, "incorrect": 1, "size": 11}
    with pytest.raises(Exception, match="no prediction for question d"):
        evaluate.strict_prediction_join(evaluate.first_truths(truth), guess.where("id <> 'd'")).collect()


def test_whole_set_metric_merges_states_in_levels(spark, monkeypatch):
    """A metric that is no expression: the median distance of answer lengths, from counts."""
    monkeypatch.setattr(evaluate, "MERGE_STATES", 3)
    rows = [("a" * (i % 7), "b" * (i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "truth string, prediction string").repartition(14)

    class Median:
        def zero(self):
            return {}

        def update(self, state, truth, prediction):
            for gap in (truth.str.len() - prediction.str.len()).abs():
                state[gap] = state.get(gap, 0) + 1
            return state

        def merge(self, one, other):
            return {k: one.get(k, 0) + other.get(k, 0) for k in one.keys() | other.keys()}

        def finish(self, state):
            return float(sorted(k for k, n in state.items() for _ in range(n))[sum(state.values()) // 2]) if state else -1.0

    gaps = sorted(abs(len(a) - len(b)) for a, b in rows)
    assert evaluate.whole_set_metric(df, Median()).first().value == gaps[250]
    assert evaluate.whole_set_metric(df.where("false"), Median()).first().value == -1.0
