import csv
import glob
import io
import json
import wave

import pytest
from pyspark.sql import functions as F

from echoloom.operators.qa import identity
from echoloom.sinks import files as sinks
from echoloom.sources import files, media

RECORD = "n int, context string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def joined(path):
    """A written document: its files in name order."""
    return "".join(open(p, encoding="utf8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_jsonl_strict(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"n":1,"context":"é"}\n\n  \n{"context":"b","extra":3,"n":2}\n', encoding="utf8")
    assert rows(files.read_jsonl(spark, str(good), RECORD)) == [(1, "é"), (2, "b")]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"n":1}\n{"n":\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_jsonl(spark, str(bad), RECORD).collect()


def test_keys_tell_null_from_absent(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"id":null,"uit_id":"u","title":null,"context":"c","question":null}\n\n{"uit_id":null,"context":"c"}\n')
    df = files.read_jsonl_with_keys(spark, str(p), files.QUESTION_SCHEMA)
    assert rows(identity(df, "keys").select("id", "title", "question")) == [
        (None, "Untitled", ""), (None, None, None)]
    assert rows(identity(df).select("id", "title", "question")) == [
        ("u", "Untitled", ""), ("unknown", "Untitled", "")]


def test_jsonl_lenient(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"n":1,"context":"a"}\n{"n":2,\n\nnot json\n{"n":3}\n')
    good, bad = files.read_jsonl_lenient(spark, str(p), RECORD)
    assert rows(good) == [(1, "a"), (3, None)]
    assert rows(bad) == [("not json",), ('{"n":2,',)]


@pytest.mark.parametrize("document,want", [
    ([{"n": 1, "context": "a"}, {"n": 2}], [(1, "a"), (2, None)]),
    ({"data": [{"n": 1}], "train": [{"n": 2}], "test": [], "n": 9}, [(1, None), (2, None)]),
    ({"data": [], "n": 9, "context": "self"}, [(9, "self")]),
    ({"n": 9, "other": [{"n": 1}]}, [(9, None)]),
])
def test_json_records(spark, tmp_path, document, want):
    p = tmp_path / "x.json"
    p.write_text(json.dumps(document, indent=2))
    assert rows(files.read_json_records(spark, str(p), RECORD)) == want
    lines = tmp_path / "x.lines"
    lines.write_text(json.dumps(document) + "\n")
    assert rows(files.read_json_records(spark, str(lines), RECORD, layout="lines")) == want


def test_wrapper_order(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps({"test": [{"n": 3}], "train": [{"n": 2}], "data": [{"n": 1}]}))
    assert [r.n for r in files.read_json_records(spark, str(p), RECORD).collect()] == [1, 2, 3]


def test_unknown_keys_are_kept(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps({"test": [{"n": 3, "z": 1.5}], "data": [{"n": 1, "more": "m"}], "test2": 0}))
    got = files.read_json_records(spark, str(p), None)
    assert set(got.columns) == {"n", "more", "z"}  # ``test2`` is a key of the document, not of a record
    assert rows(got.select("n", "more", "z")) == [(1, "m", None), (3, None, 1.5)]
    lines = tmp_path / "x.jsonl"
    lines.write_text('{"n":1,"k":{"a":2}}\n{"n":2,"other":[1]}\n')
    assert rows(files.read_jsonl(spark, str(lines), None).select("n", "k.a", "other")) == [(1, 2, None), (2, None, [1])]
    splits = files.read_splits(spark, {"a": str(lines), "b": spark.createDataFrame([(7,)], "n bigint")}, None)
    assert rows(splits.select("n", "split")) == [(1, "a"), (2, "a"), (7, "b")]


def test_contexts_and_ids(spark, tmp_path):
    items = [{"context_id": "a", "context": "A"}, {"context_id": "b", "context": "B"}, {"context_id": "a"}, {"x": 1}]
    wrapped, listed, lines = tmp_path / "w.json", tmp_path / "l.json", tmp_path / "x.jsonl"
    wrapped.write_text(json.dumps({"contexts": items}))
    listed.write_text(json.dumps(items))
    lines.write_text("\n".join(map(json.dumps, items)) + "\nbroken\n")
    one = tmp_path / "one.json"
    one.write_text('{"context_id":"a"}')
    assert rows(files.read_contexts(spark, str(wrapped)))[0] == ("a", "A")
    for p in (wrapped, listed, lines):
        assert rows(files.read_id_set(spark, str(p))) == [("a",), ("b",)]
    assert rows(files.read_id_set(spark, str(one))) == [("a",)]
    assert rows(files.read_id_set(spark, spark.createDataFrame([("q",), ("q",), (None,)], "context_id string"))) == [
        ("q",)]


def test_splits_and_frames(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text('{"n":1,"context":"a"}\n')
    frame = spark.createDataFrame([(2,)], "n int")
    got = files.read_splits(spark, {"train": str(p), "test": frame}, RECORD)
    assert rows(got) == [(1, "a", "train"), (2, None, "test")]
    for read in (lambda s: files.read_jsonl(spark, s, RECORD), lambda s: files.read_contexts(spark, s),
                 lambda s: files.read_qa_documents(spark, s), lambda s: files.read_predictions(spark, s),
                 lambda s: files.read_json_records(spark, s, RECORD)):
        assert read(frame) is frame


def test_predictions_document(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"q1": "a", "q2": "é"}, indent=4), encoding="utf8")
    assert rows(files.read_predictions(spark, str(p))) == [("q1", "a"), ("q2", "é")]


def _documents(spark, n=50):
    answers = F.array(F.struct(F.lit("ä").alias("text"), F.lit(0).cast("bigint").alias("answer_start")))
    at = F.col("id")
    return spark.range(n).repartition(4).select(
        at.alias("title_at"), at.alias("paragraph_at"), at.alias("at"), F.concat(F.lit("t"), at).alias("title"),
        F.lit("c").alias("context"), F.concat(F.lit("q"), at).alias("id"), F.lit("Q?").alias("question"),
        answers.alias("answers"))


def test_qa_documents(spark, tmp_path):
    whole, lines = str(tmp_path / "whole"), str(tmp_path / "lines")
    sinks.write_qa_documents(_documents(spark), whole, "v2")
    document = json.loads(joined(whole))
    assert document["version"] == "v2" and [d["title"] for d in document["data"]] == [f"t{i}" for i in range(50)]
    assert document["data"][0]["paragraphs"] == [{"context": "c", "qas": [
        {"id": "q0", "question": "Q?", "answers": [{"text": "ä", "answer_start": 0}]}]}]
    one = tmp_path / "one.json"
    one.write_text(json.dumps(document, indent=2, ensure_ascii=False), encoding="utf8")
    sinks.write_qa_documents(_documents(spark), lines, "v2", layout="lines")
    want = [(f"t{i}",) for i in range(50)]
    assert rows(files.read_qa_documents(spark, str(one)).select("title")) == sorted(want)
    assert rows(files.read_qa_documents(spark, lines, layout="lines").select("title")) == sorted(want)
    sinks.write_qa_documents(_documents(spark).where("false"), str(tmp_path / "none"))
    assert json.loads(joined(tmp_path / "none")) == {"version": "v1.0", "data": []}
    assert rows(files.read_qa_documents(spark, whole).select("title")) == sorted(want)


@pytest.mark.parametrize("merge", ["true", "false"])
def test_one_document_in_parts(spark, tmp_path, monkeypatch, merge):
    df = spark.range(2000).select(F.concat(F.lit("c"), "id").alias("context_id"), F.lit("ü").alias("context"),
                                  F.col("id").alias("n")).repartition(7)
    path, setting = str(tmp_path / "d"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, merge)
    try:
        sinks.write_contexts_json(df, path, "n")
    finally:
        spark.conf.set(setting, before)
    assert len(glob.glob(f"{path}/part-*")) == 1
    assert files.read_contexts(spark, path, "document").select("context_id").distinct().count() == 2000
    monkeypatch.setattr(sinks, "PART_BYTES", 10_000)
    parts = str(tmp_path / "parts")
    sinks.write_contexts_json(df, parts, "n")
    assert len(glob.glob(f"{parts}/part-*")) > 4
    assert json.loads(joined(parts)) == json.loads(joined(path))
    assert rows(files.read_contexts(spark, parts, "document")) == rows(files.read_contexts(spark, path, "document"))


def test_contexts_json(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("c"), "id").alias("context_id"), F.lit("ü").alias("context"),
                                 F.col("id").alias("n")).repartition(3)
    sinks.write_contexts_json(df, str(tmp_path / "d"), "n")
    assert json.loads(joined(tmp_path / "d"))["contexts"] == [{"context_id": f"c{i}", "context": "ü"} for i in range(100)]
    sinks.write_contexts_json(df, str(tmp_path / "l"), "n", layout="lines", per_document=30)
    documents = [json.loads(x) for x in joined(tmp_path / "l").splitlines()]
    assert sorted(len(d["contexts"]) for d in documents) == [10, 30, 30, 30]
    assert rows(files.read_contexts(spark, str(tmp_path / "l"), "lines").select("context_id")) == sorted(
        (f"c{i}",) for i in range(100))


def test_jsonl_roundtrip_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\n\"x\""), (2, None)], RECORD)
    path = str(tmp_path / "o")
    sinks.write_jsonl(df, path)
    assert "é" in joined(path) and '{"n":2}' in joined(path)
    assert rows(files.read_jsonl(spark, path, RECORD)) == [(1, "é\n\"x\""), (2, None)]
    sinks.write_jsonl(df, path, keep_nulls=True)
    assert '{"n":2,"context":null}' in joined(path)


def test_predictions_written(spark, tmp_path):
    ranked = spark.createDataFrame([("q1", 1, 'a"b', 0.9), ("q1", 2, "c", 0.1), ("q2", 1, "", 1.0)],
                                   "id string, rank int, text string, probability double")
    odds = spark.createDataFrame([("q1", -1.5)], "id string, odds double")
    sinks.write_predictions(ranked, str(tmp_path), odds)
    assert json.loads(joined(tmp_path / "predictions_test")) == {"q1": 'a"b', "q2": ""}
    assert json.loads(joined(tmp_path / "nbest_predictions_test"))["q1"] == [
        {"text": 'a"b', "probability": 0.9}, {"text": "c", "probability": 0.1}]
    assert json.loads(joined(tmp_path / "null_odds_test")) == {"q1": -1.5}
    sinks.write_predictions(ranked, str(tmp_path / "lines"), odds, layout="lines")
    assert rows(files.read_predictions(spark, str(tmp_path / "lines" / "predictions_test"), "lines")) == [
        ("q1", 'a"b'), ("q2", "")]


@pytest.mark.parametrize("methods", [["noise", "transform"], ["noise"], ["transform"], []])
def test_augment_log(spark, tmp_path, methods):
    made = [(m, f'{m}"{i}') for m in methods for i in range(12)]
    df = spark.createDataFrame(made, "method string, file string").repartition(3)
    sinks.write_augment_log(df, str(tmp_path / "log"), "file", F.col("file"))
    got = json.loads(joined(tmp_path / "log"))
    assert got == {"esc50_files": sorted(f for m, f in made if m == "noise"),
                   "torch_augmented_files": sorted(f for m, f in made if m == "transform")}
    sinks.write_augment_log(df, str(tmp_path / "lines"), "file", F.col("file"), layout="lines")
    entries = [json.loads(x) for x in joined(tmp_path / "lines").splitlines()]
    assert sorted(f for e in entries for files_ in e.values() for f in files_) == sorted(f for _, f in made)


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([("f1", 2.5), ("correct", 3.0)], "key string, value double")
    sinks.write_metrics(df, str(tmp_path / "m"))
    assert joined(tmp_path / "m") == "correct = 3.0\nf1 = 2.5\n"
    sinks.write_progress(df.coalesce(1), str(tmp_path / "p"))
    assert list(csv.reader(io.StringIO(joined(tmp_path / "p"))))[0] == ["key", "value"]


def _wav(path, frames, rate, extra=b""):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"\0\0" * frames)
    data = out.getvalue()
    if extra:
        data = data[:36] + b"LIST" + len(extra).to_bytes(4, "little") + extra + data[36:]
    path.write_bytes(data)


def test_media(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    _wav(tmp_path / "a.wav", 16000, 16000)
    _wav(tmp_path / "sub" / "B.WAV", 4000, 8000, b"data" * 20)
    (tmp_path / "c.mp3").write_bytes(b"ID3")
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    _wav(tmp_path / "odd.wav", 5, 11025)
    (tmp_path / "odd.wav").write_bytes((tmp_path / "odd.wav").read_bytes()[:22] + b"\0\0" +
                                       (tmp_path / "odd.wav").read_bytes()[24:])
    content = spark.read.format("binaryFile").load(str(tmp_path / "odd.wav"))
    assert media.media_duration(content).first().duration_s is None
    (tmp_path / "odd.wav").unlink()
    name = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    folder = str(tmp_path)
    assert name(media.list_media(spark, folder)) == ["B.WAV", "a.wav", "bad.wav", "c.mp3"]
    assert name(media.list_media(spark, folder, ".Wav")) == ["B.WAV", "a.wav", "bad.wav"]
    assert name(media.list_media(spark, folder, ".wav", recursive=False, ignore_case=False)) == ["a.wav", "bad.wav"]
    assert media.list_media(spark, folder + "/none").count() == 0
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    got = {r.path.rsplit("/", 1)[1]: r.duration_s for r in media.media_duration(content).collect()}
    assert got == {"a.wav": 1.0, "B.WAV": 0.5, "c.mp3": None, "bad.wav": None}
