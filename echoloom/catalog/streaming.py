"""Streams over files that Spark first writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions.text import content_id
from echoloom.operators import contexts as context_ops
from echoloom.operators import speech
from echoloom.session import scratch_dir
from echoloom.sinks import files as sinks
from echoloom.streaming import transcripts as ops

LINE = "seq bigint, context_id string, context string, empty_result boolean, error string, status string, " \
       "file_name string, processing_time double"


def stream_transcripts(spark, sf):
    landing, out, state = (scratch_dir(spark, n) for n in ("landing", "lines", "state"))
    results = fx.responses(spark, sf).withColumnRenamed("doc_id", "seq")
    sinks.write_jsonl(results.repartition(8, "seq"), landing)
    ops.start_transcripts(ops.read_responses(spark, landing, files_per_trigger=3), out, state).awaitTermination()
    lines = spark.read.schema(LINE).json(out)
    return ops.latest_transcripts(lines).select("file_name", "seq", "context_id", F.md5("context").alias("digest"),
                                                "status", "error")


def stream_latest(spark, sf):
    """Twice over the same state: the second stream starts from the checkpoint, with results that are late or newer."""
    landing, out, state = (scratch_dir(spark, n) for n in ("landing", "latest", "state"))
    results = fx.responses(spark, sf).withColumnRenamed("doc_id", "seq")
    for part, rows in enumerate((results.where("seq % 3 = 1"), results.where("seq % 3 <> 1"))):
        sinks.write_jsonl(rows.repartition(6, "seq"), f"{landing}/{part}")
        stream = ops.read_responses(spark, f"{landing}/*", files_per_trigger=4)
        ops.start_latest(stream, out, state).awaitTermination()
    return ops.read_latest(spark, out, LINE).select("file_name", "seq", "context_id", F.md5("context").alias("digest"),
                                                    "status", "error")


def stream_merge(spark, sf):
    landing, out, state = (scratch_dir(spark, n) for n in ("asked", "merged", "state"))
    asked = fx.contexts(spark, sf).select("doc_id", content_id("context").alias("context_id"), F.when(
        F.col("split") == "test", F.col("context")).alias("context"))
    sinks.write_jsonl(asked.repartition(8, "doc_id"), landing)
    lines = fx.responses(spark, sf).transform(speech.flatten_hypotheses).transform(
        speech.transcript_lines, keep=("doc_id",))
    known = ops.static_transcripts(context_ops.last_wins(lines, "context_id", "context", "doc_id"))
    schema = "doc_id bigint, context_id string, context string"
    questions = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).json(landing)
    query = (ops.merge_stream(questions, known).writeStream.format("json").option("path", out)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(schema).json(out).select("doc_id", "context_id", F.md5("context").alias("digest"))


QUERIES = {"stream_transcripts": stream_transcripts, "stream_latest": stream_latest, "stream_merge": stream_merge}

_TEXT = """case when error is null then coalesce(array_to_string(list_transform(
    results, lambda r: r.alternatives[1].transcript), ' '), '') end"""

ORACLE = {
    "stream_transcripts": fx.sql(f"""
select file_name, doc_id as seq, context_id, md5({_TEXT}) as digest,
  case when error is not null then 'failed' when len(results) = 0 then 'empty' else 'success' end as status, error
from (select *, row_number() over (partition by file_name order by doc_id desc) as n from f_responses) where n = 1""",
                                 "f_responses"),
    "stream_merge": fx.sql(f"""
select c.doc_id, c.context_id, md5(coalesce(t.context, c.context)) as digest
from (select doc_id, {fx.id_sql('context')} as context_id, case when split = 'test' then context end as context
  from f_contexts) c
left join (select context_id, arg_max(text, doc_id) as context from (
  select doc_id, context_id, {_TEXT} as text from f_responses) where text is not null group by context_id) t
  on c.context_id = t.context_id""", "f_contexts", "f_responses"),
}
ORACLE["stream_latest"] = ORACLE["stream_transcripts"]
