"""Recognition results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echoloom.operators.contexts import last_wins
from echoloom.operators.speech import flatten_hypotheses, transcript_lines
from echoloom.operators.spread import pick_rows
from echoloom.session import bucketed

RESPONSE_SCHEMA = ("seq bigint, context_id string, file_name string, "
                   "results array<struct<alternatives:array<struct<transcript:string,confidence:double>>>>, "
                   "error string, processing_time double")


def read_responses(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the JSON result files that land in a folder."""
    return (spark.readStream.schema(RESPONSE_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).json(path))


def _shaped(responses: DataFrame) -> DataFrame:
    return responses.transform(flatten_hypotheses).transform(
        transcript_lines, keep=("seq", "file_name", "processing_time"))


def start_transcripts(responses: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append one line per result, each exactly once, and stop when caught up.

    The job keeps no state: every completion is written, as often as a file is
    recognised, and ``latest_transcripts`` picks the last per file on reading.
    """
    return (_shaped(responses).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def start_latest(responses: DataFrame, out: str, checkpoint: str, order: str = "seq") -> StreamingQuery:
    """Keep the last line per file name as state and write each micro-batch's changes, and stop when caught up.

    The state has one row per file name, merged on the map side before the shuffle; a late result, of a smaller
    ``order``, changes nothing. The changes of a micro-batch are one folder, ``update=<number>``, which a repeated
    micro-batch replaces by equal rows, so a restart neither loses nor repeats one.
    """
    shaped = _shaped(responses)
    line = F.max_by(F.struct(*[c for c in shaped.columns if c != "file_name"]), order)
    latest = shaped.groupBy("file_name").agg(line.alias("line")).select("file_name", "line.*")

    def write(changes: DataFrame, number: int) -> None:
        changes.write.mode("overwrite").json(f"{out}/update={number}")

    return (latest.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start())


def read_latest(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The current line per file name: that of the last micro-batch that changed it."""
    updates = spark.read.schema(f"{schema}, update bigint").json(out)
    return pick_rows(updates, "file_name", "update").drop("update")


def latest_transcripts(lines: DataFrame, order: str = "seq") -> DataFrame:
    """The last line per file name."""
    whole = F.struct(*[c for c in lines.columns if c != "file_name"])
    packed = lines.select("file_name", whole.alias("line"), F.col(order))
    return last_wins(packed, "file_name", "line", order).select("file_name", "line.*")


def static_transcripts(transcripts: DataFrame, buckets: int | None = None) -> DataFrame:
    """``context_id, context`` of a table of unique ids, stored in buckets that every micro-batch can read in place."""
    tasks = buckets or int(transcripts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = transcripts.where(F.col("context_id").isNotNull()).select("context_id", "context")
    return bucketed(known.repartition(tasks, "context_id"), "context_id", tasks, "transcripts")


def merge_stream(questions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Streaming questions with a static transcript table of unique ids (``last_wins``).

    A stateless stream-static join. Of a table in buckets (``static_transcripts``) each micro-batch moves its questions
    only: they go to the buckets, which are neither shuffled nor sorted again. Questions without an id match nothing;
    they go to buckets of a digest of theirs, so that they do not meet in one task.
    """
    texts = transcripts.select(F.col("context_id").alias("_known_id"), F.col("context").alias("_transcript"))
    alone = F.concat(F.lit("\x00"), F.xxhash64(*questions.columns).cast("string"))
    keyed = questions.withColumn("_asked_id", F.coalesce("context_id", alone))
    rest = [c for c in questions.columns if c != "context"]
    return keyed.join(texts.hint("merge"), F.col("_asked_id") == F.col("_known_id"), "left").select(
        *rest, F.coalesce("_transcript", "context").alias("context"))
