import pytest
from pyspark.sql import functions as F

from echoloom.operators import speech as ops

MB = 1024 * 1024


def test_routing(spark):
    df = spark.createDataFrame(
        [(10 * MB, 60.0), (10 * MB + 1, None), (1, 60.5), (1, None), (25 * MB // 2, 100.0)], "s bigint, d double")
    got = df.select(ops.staged("s", "d"), ops.staging_reason("s", "d"), ops.staged("s", "d", force=True),
                    ops.staging_reason("s", "d", force=True)).collect()
    assert [tuple(r) for r in got] == [
        (False, "as a precaution", True, "forced"), (True, "file size 10.00MB > 10MB", True, "forced"),
        (True, "duration 60.50s > 60s", True, "forced"), (False, "as a precaution", True, "forced"),
        (True, "file size 12.50MB > 10MB", True, "forced")]


def test_retry(spark):
    df = spark.createDataFrame([(False, "x AUDIO exceeds duration Limit."), (True, "audio exceeds duration limit"),
                                (False, "other"), (False, None)], "s boolean, e string")
    assert [r[0] for r in df.select(ops.retry_staged("s", "e")).collect()] == [True, False, False, False]


RESPONSES = [
    ("a", [([("one", 0.9), ("won", 0.1)],), ([],), ([("two", None)],)], None),
    ("b", [([("", 0.5)],)], None), ("c", [([],)], None), ("d", [], None), ("e", None, None), ("f", None, "boom")]


def _lines(spark):
    df = spark.createDataFrame(
        [(*r, r[0] + ".wav", float(i)) for i, r in enumerate(RESPONSES)],
        "context_id string, results array<struct<alternatives:array<struct<transcript:string,confidence:double>>>>, "
        "error string, file_name string, processing_time double")
    return ops.flatten_hypotheses(df)


def test_flatten(spark):
    got = {r.context_id: r for r in _lines(spark).collect()}
    assert got["a"].transcription == "one two" and not got["a"].empty_result
    assert [[tuple(x) for x in a] for a in got["a"].all_alternatives] == [[("one", 0.9), ("won", 0.1)], [("two", 0.0)]]
    # A segment whose only text is empty still counts as text.
    assert (got["b"].transcription, got["b"].empty_result) == ("", False)
    assert all(got[k].empty_result and got[k].transcription == "" for k in "cde")
    assert got["f"].transcription is None and got["f"].all_alternatives is None and got["f"].empty_result


def test_lines_and_summary(spark):
    lines = ops.transcript_lines(_lines(spark))
    got = [tuple(r)[:5] for r in lines.orderBy("context_id").collect()]
    assert got == [("a", "one two", None, None, "success"), ("b", "", None, None, "success"),
                   ("c", "", True, None, "empty"), ("d", "", True, None, "empty"), ("e", "", True, None, "empty"),
                   ("f", None, None, "boom", "failed")]
    assert tuple(ops.batch_summary(lines).first()) == (2, 3, 1, 6, 15.0, 2.5)
    assert tuple(ops.batch_summary(lines.where("false")).first()) == (0, 0, 0, 0, 0.0, 0.0)
    unknown = spark.createDataFrame([("g", None, None, None)],
                                    "context_id string, transcription string, empty_result boolean, error string")
    assert ops.transcript_lines(unknown, keep=()).first().error == "Unknown error"


def test_voices(spark):
    df = spark.createDataFrame([("vi-Neural2-A",), ("vi-Chirp3-HD-x",), ("vi-wavenet-A",), ("vi-Standard-A",)], "n string")
    assert [r[0] for r in df.select(ops.voice_type("n")).collect()] == ["NEURAL", "NEURAL", "STANDARD", "STANDARD"]


def test_metadata_keeps_successes(spark):
    texts = spark.createDataFrame([("ctx_1", "héllo", True), ("ctx_2", "x", False)],
                                  "context_id string, context string, success boolean")
    voices = spark.createDataFrame([(0, "vi-Neural2-A", "MALE"), (1, "vi-Standard-B", "FEMALE")],
                                   "idx int, voice_name string, voice_gender string")
    row = ops.synthesis_metadata(texts, voices).collect()
    assert [(r.context_id, r.audio_file, r.context_length) for r in row] == [("ctx_1", "ctx_1.mp3", 5)]
    assert row[0].timestamp > 1.6e9
    with pytest.raises(Exception, match="catalogue is empty"):
        ops.assign(texts, voices.where("false"), "context_id", 0).collect()
    gaps = voices.withColumn("idx", F.col("idx") * 7 + 3)
    assert sorted(ops.assign(texts, gaps, "context_id", 0).collect()) == sorted(
        ops.assign(texts, voices, "context_id", 0).collect())


def _resolve(refs, files, base):
    """The rule by plain loops over a set of paths."""
    found, missing = [], []
    for n, audio_path, file_path, audio_file, cid in refs:
        wanted = next((p for p in (audio_path, file_path) if p), None) or audio_file or None
        if wanted and not wanted.startswith("/"):
            wanted = f"{base}/{wanted}"
        if wanted is None and cid:
            hit = next((p for p in (f"{base}/{cid}.wav", f"{base}/{cid}.mp3") if p in files), None)
            if hit:
                found.append((n, hit))
        elif wanted in files:
            found.append((n, wanted))
        elif wanted:
            folder, name = wanted.rsplit("/", 1)
            same = [f for f in files if f.rsplit("/", 1)[0] == folder and f.rsplit("/", 1)[1].lower() == name.lower()]
            found.append((n, min(same))) if same else missing.append((n, wanted))
    return found, missing


def test_resolve_media(spark):
    files = ["/m/a.wav", "/m/B.WAV", "/m/b.Wav", "/m/c.mp3", "/m/d.wav", "/m/d.mp3", "/m/sub/a.wav"]
    refs = [(1, "a.wav", None, None, None), (2, "/m/A.WAV", None, None, "x"), (3, "b.wav", None, None, None),
            (4, "", "sub/a.wav", None, None), (5, None, None, "c.MP3", None), (6, None, None, None, "c"),
            (7, None, None, None, "d"), (8, None, None, None, "D"), (9, "/M/a.wav", None, None, None),
            (10, "gone.wav", None, None, "c"), (11, None, None, None, None), (12, "", "", "", "")]
    df = spark.createDataFrame(refs, "n int, audio_path string, file_path string, audio_file string, context_id string")
    listing = spark.createDataFrame([(f,) for f in files], "path string")
    done = ops.resolve_media(df, listing, "/m")
    found, missing = _resolve(refs, set(files), "/m")
    assert sorted((r.n, r.media_path) for r in ops.resolved_media(done).collect()) == found
    assert sorted((r.n, r.wanted) for r in ops.missing_media(done).collect()) == missing
    assert len(found) == 7 and len(missing) == 2 and done.count() == 12


@pytest.mark.parametrize("path,want", [("/x/ctx_1.wav", "ctx_1"), ("ctx_1.tar.gz", "ctx_1.tar")])
def test_id_from_path(spark, path, want):
    assert spark.range(1).select(ops.id_from_path(F.lit(path))).first()[0] == want
