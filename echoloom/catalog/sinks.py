"""Writers, checked by reading back what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import augment as augment_queries
from echoloom.catalog import evaluate as evaluate_queries
from echoloom.catalog import fixtures as fx
from echoloom.catalog import runs as run_queries
from echoloom.catalog import speech as speech_queries
from echoloom.catalog.augment import SEED
from echoloom.functions.text import hash_order
from echoloom.operators import augment as augment_ops
from echoloom.operators import contexts as context_ops
from echoloom.operators import qa as qa_ops
from echoloom.operators import scoring as scoring_ops
from echoloom.session import scratch_dir
from echoloom.sinks import files as sinks
from echoloom.sources import files as sources


def roundtrip_jsonl(spark, sf):
    path = scratch_dir(spark, "roundtrip")
    columns = ("id", "uit_id", "title", "context", "question", "answers")
    sinks.write_jsonl(fx.qa(spark, sf).select(*columns), path)
    back = sources.read_jsonl(spark, path, sources.QUESTION_SCHEMA)
    return back.select("id", "uit_id", "title", F.md5("context").alias("context"), F.md5("question").alias("question"),
                       F.array_join("answers.text", "|").alias("texts"),
                       F.array_join(F.col("answers.answer_start").cast("array<string>"), "|").alias("starts"))


def write_contexts_json(spark, sf):
    path = scratch_dir(spark, "contexts-document")
    found = context_ops.distinct_contexts(fx.contexts(spark, sf), "doc_id")
    sinks.write_contexts_json(found, path, "first_seen")
    return sources.read_contexts(spark, path, layout="document").select("context_id", F.md5("context").alias("digest"))


def write_qa_document(spark, sf):
    path = scratch_dir(spark, "qa-document")
    sinks.write_qa_documents(qa_ops.nest(fx.qa(spark, sf), "ord"), path)
    return qa_ops.flatten_documents(sources.read_qa_documents(spark, path)).select(
        "title", "id", F.md5("context").alias("context"), F.size("answers").alias("answers"))


def export_splits(spark, sf):
    path = scratch_dir(spark, "splits")
    sinks.export_splits(fx.contexts(spark, sf), path)
    back = spark.read.schema("doc_id bigint, context string, title string, split string").json(path)
    return back.select("doc_id", "title", "split", F.md5("context").alias("digest"))


def write_predictions(spark, sf):
    path = scratch_dir(spark, "answers")
    logits = fx.logits(spark, sf).withColumn("id", F.concat(F.lit("v"), "id"))
    nulls = scoring_ops.null_scores(logits)
    spans = scoring_ops.nbest_spans(logits, "id", n_best=5, max_answer_length=30, first=1)
    odds = scoring_ops.null_odds(spans, nulls)
    sinks.write_predictions(scoring_ops.with_null_answer(spans, nulls, n_best=5), path, odds)

    def entries(name, kind):
        return sources.read_json_entries(spark, f"{path}/{name}", kind).withColumnRenamed("key", "id")

    nbest = entries("nbest_predictions_test", "array<struct<text:string,probability:double>>")
    return (sources.read_predictions(spark, f"{path}/predictions_test")
            .join(nbest.select("id", F.array_join("value.text", "|").alias("nbest")), "id")
            .join(entries("null_odds_test", "double").select("id", F.round("value", 6).alias("odds")), "id"))


def write_augment_log(spark, sf):
    """The written lists again as rows."""
    path = scratch_dir(spark, "augment-log")
    files = fx.table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id", F.lit(".mp3")).alias("file"))
    sinks.write_augment_log(augment_ops.ratio_split(files, "file", seed=SEED), path, "file", hash_order(SEED, "file"))
    method = F.when(F.col("key") == sinks.NOISE_FILES, "noise").otherwise("transform")
    lists = sources.read_json_lists(spark, path, (sinks.NOISE_FILES, sinks.TRANSFORMED_FILES), "string")
    return lists.select(F.col("value").alias("file"), method.alias("method"))


def write_metrics(spark, sf):
    path = scratch_dir(spark, "metrics")
    report = evaluate_queries.em_f1(spark, sf)
    pairs = report.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("key"), F.format_string("%.4f", F.col(c).cast("double")).alias("value"))
        for c in report.columns])))
    sinks.write_metrics(pairs, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_synthesis_metadata(spark, sf):
    """One line per context to synthesise, read back."""
    path = scratch_dir(spark, "synthesis")
    made = speech_queries.synthesis_metadata(spark, sf)
    sinks.write_jsonl(made, path)
    return sources.read_jsonl(spark, path, made.schema)


def write_progress(spark, sf):
    """The loss of each logging window as CSV with a header, read back."""
    path = scratch_dir(spark, "progress")
    made = run_queries.logging_window_mean(spark, sf)
    sinks.write_progress(made, path)
    return spark.read.schema(made.schema).option("header", True).option("enforceSchema", False).option(
        "mode", "FAILFAST").csv(path)


QUERIES = {
    "roundtrip_jsonl": roundtrip_jsonl, "write_contexts_json": write_contexts_json,
    "write_qa_document": write_qa_document, "export_splits": export_splits,
    "write_predictions": write_predictions, "write_augment_log": write_augment_log, "write_metrics": write_metrics,
    "write_synthesis_metadata": write_synthesis_metadata, "write_progress": write_progress,
}

_REPORT = evaluate_queries.ORACLE["em_f1"]
_SPANS = """
select * from (
  select s.id, s.i as start, e.i as "end", s.v + e.v as score,
    row_number() over (partition by s.id order by s.v + e.v desc, s.i, e.i) as rank
  from starts s join ends e on s.id = e.id and s.r <= 5 and e.r <= 5 and s.i >= 1 and e.i >= s.i
    and e.i - s.i + 1 <= 30)
where rank <= 5"""
_NULLS = "select id, start_logits[1] + end_logits[1] as score from f_logits"
_LISTED = """
select id, text, least(r, 6) as rank from (
  select *, row_number() over (partition by id order by score desc, missing, start, "end") as r from (
    select id, start || '-' || "end" as text, score, false as missing, start, "end" from spans
    union all select id, '', score, true, null, null from nulls_))
where missing or r <= 5"""
_STARTS = """
select id, v, i, row_number() over (partition by id order by v desc, i) as r
from (select id, unnest({0}) as v, unnest(range(0, len({0}))) as i from f_logits)"""

ORACLE = {
    "roundtrip_jsonl": fx.sql("""
select id, uit_id, title, md5(context) as context, md5(question) as question, a1 || '|' || a2 as texts,
  array_to_string(answers.answer_start, '|') as starts from f_qa""", "f_qa"),
    "write_contexts_json": fx.sql(f"""
select distinct {fx.id_sql('s')} as context_id, md5(s) as digest
from (select {fx.strip_sql('context')} as s from f_contexts) where s <> ''""", "f_contexts"),
    "write_qa_document": fx.sql("""
select coalesce(title, 'Untitled') as title, coalesce(id, uit_id) as id, md5(context) as context,
  (a1 <> '')::int + (a2 <> '')::int as answers
from f_qa where len(answers.answer_start) = 2 and (a1 <> '' or a2 <> '')""", "f_qa"),
    "export_splits": fx.sql("select doc_id, title, split, md5(context) as digest from f_contexts", "f_contexts"),
    "write_predictions": fx.sql("""
select 'v' || l.id as id, max(text) filter (rank = 1) as prediction, string_agg(text, '|' order by rank) as nbest,
  round(max(o.odds), 6) as odds
from listed l join (select n.id, n.score - coalesce(s.score, 0) as odds from nulls_ n
  left join spans s on n.id = s.id and s.rank = 1) o on l.id = o.id
group by l.id""", "f_logits", starts=_STARTS.format("start_logits"), ends=_STARTS.format("end_logits"),
                                spans=_SPANS, nulls_=_NULLS, listed=_LISTED),
    "write_augment_log": augment_queries.ORACLE["ratio_split"],
    "write_metrics": f"""
select key || ' = ' || printf('%.4f', value) as line from (
  unpivot (select questions::double as questions, answered::double as answered, rejected::double as rejected,
    exact_match::double as exact_match, f1::double as f1 from ({_REPORT})) on columns(*) into name key value value)""",
}
ORACLE["write_synthesis_metadata"] = speech_queries.ORACLE["synthesis_metadata"]
ORACLE["write_progress"] = run_queries.ORACLE["logging_window_mean"]
