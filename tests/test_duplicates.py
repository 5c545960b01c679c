"""Repeated ids count once, the last one, and partial documents are refused."""

import json

import pytest

from echoloom.operators import contexts, evaluate
from echoloom.operators.spread import lookup_join
from echoloom.sources import files


def one(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_last_prediction_and_truth_count(spark):
    truth = one(spark, [("a", ["x"]), ("u", ["p"]), ("u", ["q"]), (None, ["z"])], "id string, truths array<string>")
    said = one(spark, [("a", "wrong"), ("a", "x"), ("u", "q")], "id string, prediction string")
    row = evaluate.em_f1(evaluate.question_scores(truth, said)).first()
    assert (row.questions, row.answered) == (3, 2)
    assert row.exact_match == pytest.approx(200 / 3)
    first = one(spark, [("a", "x"), ("u", "p"), ("u", "q")], "id string, truth string")
    judged = evaluate.verdict_counts(evaluate.verdicts(evaluate.strict_prediction_join(first, said))).first()
    assert (judged.correct, judged.similar, judged.incorrect) == (2, 0, 0)


def test_the_order_is_a_column_of_the_source(spark):
    """After a shuffle only a column tells which row was the last."""
    rows = [(f"k{i % 50}", f"v{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, prediction string, n long").repartition(7, "prediction")
    last = {k: v for k, v, _ in rows}
    first = {k: v for k, v, _ in reversed(rows)}
    assert {r.id: r.prediction for r in evaluate.last_rows(df, order="n").collect()} == last
    assert {r.id: r.prediction for r in contexts.first_seen(df, "id", "n").collect()} == first
    latest = contexts.last_wins(df, "id", "prediction", "n")
    assert {r.id: r.prediction for r in latest.collect()} == last
    truth = spark.createDataFrame([(k, v, 0) for k, v in last.items()], "id string, truth string, n long")
    judged = evaluate.verdict_counts(evaluate.verdicts(evaluate.strict_prediction_join(truth, df, "n"))).first()
    assert judged.correct == 50


def test_winners_are_picked_without_sorting_texts(spark, capsys):
    df = spark.createDataFrame([("k", "text", 1), ("k", None, 2), (None, "x", 3)], "k string, v string, n long")
    for plan in (contexts.last_wins(df, "k", "v", "n"), contexts.first_seen(df, "k", "n")):
        plan.explain()
        assert "SortAggregate" not in capsys.readouterr().out
    assert [tuple(r) for r in contexts.last_wins(df, "k", "v", "n").collect()] == [("k", "text")]
    assert sorted(r.n for r in contexts.first_seen(df, "k", "n").collect()) == [1, 3]


def test_last_id_of_a_text_wins(spark):
    rows = one(spark, [(1, "t"), (2, "other")], "n int, context string")
    known = one(spark, [("old", "t"), ("new", "t")], "context_id string, context string")
    assert [(r.n, r.context_id) for r in contexts.replace_contexts(rows, known).orderBy("n").collect()] == [
        (1, "new"), (2, None)]


def test_many_hot_keys_are_all_split(spark):
    left = spark.range(6000, numPartitions=4).selectExpr("id div 4 as k", "id")
    right = spark.range(1500).selectExpr("id as k", "id * 2 as v")
    got = lookup_join(left, right, "k", hot_rows=2)
    assert got.count() == 6000 and got.where("v <> k * 2 or v is null").count() == 0


@pytest.mark.parametrize("text", ['{"contexts":[{"context_id":"a","context":"x"},', ',{"context_id":"b"}]}'])
def test_partial_documents_fail(spark, tmp_path, text):
    (tmp_path / "part.json").write_text(text)
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        files.read_contexts(spark, str(tmp_path / "part.json")).collect()


def test_partial_question_document_fails(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{"version":"v1","data":[{"title":"t","paragraphs":[')
    with pytest.raises(Exception):
        files.read_qa_documents(spark, str(tmp_path / "doc.json")).collect()


def test_blank_lines_of_any_kind(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\t\n{"id":"a"}\n \u2003\n')
    good, bad = files.read_jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "id string")
    assert (good.count(), bad.count()) == (1, 0)


def test_a_key_of_two_types_keeps_both_values(spark, tmp_path):
    (tmp_path / "mixed.json").write_text(json.dumps(
        {"data": [{"id": 1, "n": 1}], "train": [{"id": "abc", "n": 1.5}]}))
    got = files.read_json_records(spark, str(tmp_path / "mixed.json"), None)
    assert sorted((r.id, r.n) for r in got.collect()) == [("1", 1.0), ("abc", 1.5)]
