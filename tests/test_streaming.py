import json

from pyspark.sql import functions as F

from echoloom.operators import contexts, speech
from echoloom.streaming import transcripts as ops


def _result(seq, name, text=None, error=None):
    made = {"seq": seq, "context_id": name, "file_name": f"{name}.wav", "processing_time": 1.0}
    if error:
        return {**made, "error": error}
    return {**made, "results": [{"alternatives": [{"transcript": text, "confidence": 0.5}]}] if text else []}


def _write(folder, name, items):
    (folder / name).write_text("\n".join(map(json.dumps, items)))


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    _write(landing, "1.json", [_result(1, "a", "one"), _result(2, "b", error="boom"), _result(3, "c")])
    ops.start_transcripts(ops.read_responses(spark, str(landing)), out, state).awaitTermination()
    _write(landing, "2.json", [_result(4, "b", "later"), _result(5, "a", "again")])
    ops.start_transcripts(ops.read_responses(spark, str(landing)), out, state).awaitTermination()
    schema = "seq bigint, context_id string, context string, empty_result boolean, error string, status string, " \
             "file_name string, processing_time double"
    lines = spark.read.schema(schema).json(out)
    batch = spark.read.schema(ops.RESPONSE_SCHEMA).json(str(landing)).transform(speech.flatten_hypotheses).transform(
        speech.transcript_lines, keep=("seq", "file_name", "processing_time"))
    order = ["seq", "context_id", "context", "empty_result", "error", "status", "file_name"]
    assert sorted(map(tuple, lines.select(*order).collect()), key=str) == sorted(
        map(tuple, batch.select(*order).collect()), key=str)
    latest = {r.file_name: (r.seq, r.context) for r in ops.latest_transcripts(lines).collect()}
    assert latest == {"a.wav": (5, "again"), "b.wav": (4, "later"), "c.wav": (3, "")}


def test_stream_merge(spark, tmp_path):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for i in range(4):
        _write(landing, f"{i}.json", [{"n": i, "context_id": "ab"[i % 2], "context": "old"}, {"n": i + 10}])
    schema = "n int, context_id string, context string"
    lines = spark.createDataFrame([("a", "x", 1), ("a", "new", 2)], "context_id string, context string, at int")
    known = contexts.last_wins(lines, "context_id", "context", "at")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing))
    (ops.merge_stream(stream, known).writeStream.format("json").option("path", out)
     .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination())
    got = {r.n: r.context for r in spark.read.schema(schema).json(out).where(F.col("n") < 10).collect()}
    assert got == {0: "new", 1: "old", 2: "new", 3: "old"}


def test_latest_per_file_over_restarts(spark, tmp_path):
    """After each run the table equals the batch result; late results change nothing."""
    landing, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    landing.mkdir()
    runs = [[_result(1, "a", "one"), _result(5, "b", error="boom"), _result(3, "c")],
            [_result(4, "b", "late"), _result(6, "a", "again"), _result(2, "d", "new")],
            [_result(7, "a"), _result(8, "d", error="gone"), _result(9, "e", "last")]]
    schema = "seq bigint, context_id string, context string, empty_result boolean, error string, status string, " \
             "file_name string, processing_time double"
    for number, items in enumerate(runs):
        for i, item in enumerate(items):
            _write(landing, f"{number}-{i}.json", [item])
        stream = ops.read_responses(spark, str(landing), files_per_trigger=1)
        ops.start_latest(stream, out, state).awaitTermination()
        batch = spark.read.schema(ops.RESPONSE_SCHEMA).json(str(landing))
        want = ops.latest_transcripts(ops._shaped(batch))
        names = ["file_name", "seq", "context", "error", "status"]
        got = ops.read_latest(spark, out, schema)
        assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(
            map(tuple, want.select(names).collect()), key=str)
    assert len(list((tmp_path / "out").glob("update=*"))) == 9


def test_static_side_stays_in_its_buckets(spark, tmp_path, capsys):
    landing, out = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()
    for i in range(3):
        _write(landing, f"{i}.json", [{"n": i, "context_id": f"k{i}", "context": "old"}, {"n": i + 10, "context": "own"}])
    known = ops.static_transcripts(spark.range(2000).selectExpr("concat('k', id) as context_id", "'new' as context"), 4)
    schema = "n int, context_id string, context string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(landing))
    query = (ops.merge_stream(stream, known).writeStream.format("json").option("path", out)
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.n: r.context for r in spark.read.schema(schema).json(out).collect()}
    assert got == {0: "new", 1: "new", 2: "new", 10: "own", 11: "own", 12: "own"}
    ops.merge_stream(spark.read.schema(schema).json(str(landing)), known).explain()
    lines = capsys.readouterr().out.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    above, level = [], depth[at]
    for i in reversed(range(at)):
        if depth[i] < level:
            above.append(lines[i])
            level = depth[i]
    assert "SortMergeJoin" in "".join(above) and "Exchange" not in "".join(above)
