import random

import pytest
from pyspark.sql import functions as F

from echoloom.operators import qa as ops
from echoloom.sinks import files as sinks
from echoloom.sources import files

SCHEMA = ("ord bigint, id string, uit_id string, title string, context string, question string, "
          "answers struct<text:array<string>,answer_start:array<int>>")


def _rows(n=600):
    rng = random.Random(3)
    out = []
    for i in range(n):
        texts = rng.choice([["a"], ["a", ""], [""], ["a", "b"], []])
        starts = [3] * (len(texts) if rng.random() < 0.9 else len(texts) + 1)
        answers = None if rng.random() < 0.05 else (texts, starts)
        title = rng.choice(["hot", "hot", "hot", "t1", "t2", None])
        context = rng.choice(["c-hot", "c-hot", "c1", "c2", "", None])
        out.append((i * 3, rng.choice([f"q{i}", None]), rng.choice([f"u{i}", None]), title, context,
                    rng.choice([f"Q{i}", None]), answers))
    return out


def _expected(rows):
    """Title -> context -> questions, in input order, by plain loops."""
    titles = {}
    for _, qid, uit, title, context, question, answers in rows:
        if not context:
            continue
        pairs = []
        if answers and len(answers[0]) == len(answers[1]):
            pairs = [(t, s) for t, s in zip(*answers) if t]
        if pairs:
            key = "Untitled" if title is None else title
            qid = qid if qid is not None else uit if uit is not None else "unknown"
            titles.setdefault(key, {}).setdefault(context, []).append((qid, question or "", pairs))
    return titles


def _nested(documents):
    titles = {}
    for r in sorted(documents.collect(), key=lambda r: (r.title_at, r.paragraph_at, r["at"])):
        titles.setdefault(r.title, {}).setdefault(r.context, []).append(
            (r.id, r.question, [(a.text, a.answer_start) for a in r.answers]))
    return titles


def _ordered(titles):
    return [(t, list(ps.items())) for t, ps in titles.items()]


def _check(docs, want):
    stats = tuple(ops.document_stats(docs).first())
    assert stats == (len(want), sum(map(len, want.values())), sum(len(q) for t in want.values() for q in t.values()))
    examples = {}
    for e in sorted(ops.to_examples(docs).collect(), key=lambda e: e["at"]):
        assert not e.is_impossible
        examples.setdefault((e.title, e.context), []).append(e.id)
    assert examples == {(t, next(iter(ps))): [q[0] for q in next(iter(ps.values()))] for t, ps in want.items()}
    flat = sorted((r.title, r.context, r.id, r.question) for r in ops.flatten_documents(docs).collect())
    assert flat == sorted((t, c, q[0], q[1]) for t, ps in want.items() for c, qs in ps.items() for q in qs)


@pytest.mark.parametrize("one_title", [False, True])
def test_nest_in_memory_and_read_again(spark, tmp_path, one_title):
    data = _rows()
    if one_title:
        data = [(*r[:3], "all", *r[4:]) for r in data]
    rng = random.Random(4)
    df = spark.createDataFrame(rng.sample(data, len(data)), SCHEMA).repartition(5)
    docs = ops.nest(df, "ord")
    want = _expected(data)
    assert _ordered(_nested(docs)) == _ordered(want)
    _check(docs, want)
    whole, lines = str(tmp_path / "whole"), str(tmp_path / "lines")
    sinks.write_qa_documents(docs, whole)
    _check(files.read_qa_documents(spark, whole), want)
    sinks.write_qa_documents(docs, lines, layout="lines", per_line=30)
    back = files.read_qa_documents(spark, lines, layout="lines")
    _check(back, want)
    assert max(len(p.qas) for r in back.collect() for p in r.paragraphs) <= 30
    assert _ordered(_nested(ops.to_examples(back))) == _ordered({t: dict(list(ps.items())[:1]) for t, ps in want.items()})


def test_documents_with_empty_parts(spark):
    docs = spark.createDataFrame(
        [("t", [("c1", [("q1", "Q", [("a", 0)])]), ("c2", [])]), ("none", []),
         ("late", [("c3", []), ("c4", [("q2", "Q", [])])])],
        "title string, paragraphs array<struct<context:string,qas:array<struct<id:string,question:string,"
        "answers:array<struct<text:string,answer_start:bigint>>>>>>")
    assert [(r.title, r.context, r.id, r.is_impossible) for r in ops.to_examples(docs).collect()] == [
        ("t", "c1", "q1", False)]
    assert tuple(ops.document_stats(docs).first()) == (3, 4, 2)
    assert ops.flatten_documents(docs).count() == 2


@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_merge_transcripts(spark, hot_rows):
    questions = spark.createDataFrame(
        [(1, "a", None), (2, "b", "old"), (3, None, "kept"), (4, "z", "kept"), (5, "a", "old"), (6, "a", None),
         (7, "e", "old")], "n int, context_id string, context string")
    lines = spark.createDataFrame(
        [("a", "first", 1), ("a", "last", 2), ("a", None, 3), ("b", None, 1), ("e", "", 1)],
        "context_id string, context string, at int")
    done = ops.merge_transcripts(questions, lines, "at", hot_rows)
    assert [tuple(r) for r in done.orderBy("n").collect()] == [
        (1, "a", "last"), (2, "b", "old"), (3, None, "kept"), (4, "z", "kept"), (5, "a", "last"), (6, "a", "last"),
        (7, "e", "")]
    assert tuple(ops.merge_stats(done).first()) == (7, 7)


def test_trim_null_answer(spark):
    df = spark.createDataFrame([(["a", ""], [0.9, 0.1]), ([], [])], "answer array<string>, probability array<double>")
    assert [tuple(r) for r in ops.trim_null_answer(df).collect()] == [(["a"], [0.9]), ([], [])]
