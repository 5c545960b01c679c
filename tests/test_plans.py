import glob
import json

from echoloom.catalog.scoring import lexical_scorer
from echoloom.operators import scoring
from echoloom.operators.spread import number_rows
from echoloom.plans import build, evaluate
from echoloom.sources import files


def _records():
    for i in range(12):
        context = f" The river number {i // 3} flows north. It is long. "
        answers = {"text": ["north"], "answer_start": [context.index("north")]} if i % 4 else {"text": [], "answer_start": []}
        yield {"id": f"q{i}", "title": f"t{i // 6}", "context": context, "question": "Where does the river flow",
               "answers": answers}


def test_files_to_scores(spark, tmp_path):
    source = tmp_path / "train.jsonl"
    source.write_text("\n".join(map(json.dumps, _records())))
    records = number_rows(files.read_jsonl(spark, str(source), files.QUESTION_SCHEMA))
    dictionary, questions = build.prepare(records, "ord")
    assert dictionary.count() == 4
    assert questions.where("context_id is null or context is not null").count() == 0

    voices = spark.createDataFrame([(0, "vi-Neural2-A", "MALE")], "idx int, voice_name string, voice_gender string")
    plan = build.plan_synthesis(questions, dictionary, voices).collect()
    assert len(plan) == 4 and {p.voice_type for p in plan} == {"NEURAL"}
    assert len(build.plan_synthesis(questions, dictionary, voices, limit=2).collect()) == 2

    # The recogniser hears every text but the last, which fails.
    heard = [(n, p.context_id, f"{p.context_id}.wav", [([(f"River {n}  flows NORTH", 0.9)],)] if n < 3 else None,
              None if n < 3 else "boom", 1.0) for n, p in enumerate(plan)]
    results = spark.createDataFrame(
        heard, "seq bigint, context_id string, file_name string, "
        "results array<struct<alternatives:array<struct<transcript:string,confidence:double>>>>, "
        "error string, processing_time double")
    merged = build.merge(questions, build.transcripts(results, "seq"), "seq")
    documents = build.documents(merged, "ord")
    texts = {r.context for r in documents.collect()}
    assert texts == {f"river {n} flows north" for n in range(3)}

    knobs = dict(n_best=2, max_seq_length=32, max_query_length=8, doc_stride=4)
    ranked = evaluate.predict(documents, lexical_scorer, **knobs)
    predictions = scoring.best_predictions(ranked, evaluate.questions(documents))
    report = evaluate.report(documents, predictions).first()
    asked = documents.count()
    assert report.questions == asked and 0 < report.answered <= asked and report.rejected == 0

    whole = merged.selectExpr("*", "'train' as split")
    build.export(whole, "ord", str(tmp_path / "out"), ("train", "test"))
    written = {s: json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/{s}/part-*"))))
               for s in ("train", "test")}
    assert sum(len(p["qas"]) for d in written["train"]["data"] for p in d["paragraphs"]) == asked
    assert written["test"]["data"] == []
