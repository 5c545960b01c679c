"""Answers, identity, transcript merge and nesting."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions.text import content_id
from echoloom.operators import qa as ops
from echoloom.operators import speech
from echoloom.session import materialize


def zip_answers(spark, sf):
    pairs = F.transform(ops.zip_answers("answers"), lambda a: F.concat(
        a["text"], F.lit("@"), a["answer_start"].cast("string")))
    return fx.qa(spark, sf).select("uit_id", F.size(pairs).alias("n"), F.array_join(pairs, "|").alias("pairs"))


def qa_identity(spark, sf):
    return ops.identity(fx.qa(spark, sf)).select("uit_id", "id", "title", F.md5("question").alias("question"),
                                                 F.md5("context").alias("context"))


def answerable_only(spark, sf):
    return ops.answerable(fx.qa(spark, sf)).select("id", "title", F.size("answers").alias("answers"))


def _documents(spark, sf):
    return ops.nest(fx.qa(spark, sf), "ord")


def nest_qa(spark, sf):
    return _documents(spark, sf).select("title_at", "paragraph_at", "at", "title", F.md5("context").alias("context"),
                                        "id", F.array_join("answers.text", "|").alias("answers"))


def qa_document_stats(spark, sf):
    return ops.document_stats(_documents(spark, sf))


def to_examples(spark, sf):
    examples = ops.to_examples(materialize(_documents(spark, sf), "documents"))
    return examples.groupBy("title_at").agg(
        F.any_value("title").alias("title"), F.any_value(F.md5("context")).alias("context"),
        F.count("*").alias("questions"), F.bool_or("is_impossible").alias("impossible")).drop("title_at")


def _merged(spark, sf):
    """Records by id, and what the recogniser made of each context."""
    records = fx.contexts(spark, sf).select("doc_id", content_id("context").alias("context_id"),
                                            F.when(F.col("split") == "test", F.col("context")).alias("context"))
    lines = fx.responses(spark, sf).transform(speech.flatten_hypotheses).transform(
        speech.transcript_lines, keep=("doc_id",))
    return ops.merge_transcripts(records, lines, "doc_id")


def merge_transcripts(spark, sf):
    return _merged(spark, sf).select("doc_id", "context_id", F.md5("context").alias("digest"))


def merge_stats(spark, sf):
    return ops.merge_stats(_merged(spark, sf))


QUERIES = {
    "zip_answers": zip_answers, "qa_identity": qa_identity, "answerable_only": answerable_only,
    "nest_qa": nest_qa, "qa_document_stats": qa_document_stats, "to_examples": to_examples,
    "merge_transcripts": merge_transcripts, "merge_stats": merge_stats,
}

_ANSWERS = """
select *, case when len(answers.answer_start) = 2 then list_filter(
    [{'t': a1, 's': answers.answer_start[1]}, {'t': a2, 's': answers.answer_start[2]}], lambda a: a.t <> '')
  else [] end as pairs from f_qa"""
_GOOD = """
select coalesce(id, uit_id, 'unknown') as qid, coalesce(title, 'Untitled') as ttl, * from zipped
where coalesce(context, '') <> '' and len(pairs) > 0"""
_PLACED = """
select *, dense_rank() over (partition by ttl order by par) - 1 as paragraph,
  row_number() over (partition by ttl, context order by ord) - 1 as place
from (select *, min(ord) over (partition by ttl, context) as par from good)"""
DOCUMENTS = {"zipped": _ANSWERS, "good": _GOOD, "placed": _PLACED}
_MERGED = """
select c.doc_id, c.context_id, coalesce(t.context, c.context) as context
from (select doc_id, concat('ctx_', substr(md5(context), 1, 8)) as context_id,
    case when split = 'test' then context end as context from f_contexts) c
left join (select context_id, arg_max(context, doc_id) as context from (
  select doc_id, context_id, case when error is null then coalesce(array_to_string(list_transform(
      results, lambda r: r.alternatives[1].transcript), ' '), '') end as context from f_responses)
  where context is not null group by context_id) t on c.context_id = t.context_id"""

ORACLE = {
    "zip_answers": fx.sql("""
select uit_id, len(pairs) as n, coalesce(array_to_string(list_transform(pairs, lambda a: a.t || '@' || a.s), '|'), '')
  as pairs from zipped""", "f_qa", zipped=_ANSWERS),
    "qa_identity": fx.sql("""
select uit_id, coalesce(id, uit_id, 'unknown') as id, coalesce(title, 'Untitled') as title,
  md5(coalesce(question, '')) as question, md5(coalesce(context, '')) as context from f_qa""", "f_qa"),
    "answerable_only": fx.sql("select qid as id, ttl as title, len(pairs) as answers from good", "f_qa",
                              zipped=_ANSWERS, good=_GOOD),
    "nest_qa": fx.sql("""
select min(ord) over (partition by ttl) as title_at, min(ord) over (partition by ttl, context) as paragraph_at,
  ord as at, ttl as title, md5(context) as context, qid as id,
  array_to_string(list_transform(pairs, lambda a: a.t), '|') as answers from good""", "f_qa", zipped=_ANSWERS,
                      good=_GOOD),
    "qa_document_stats": fx.sql("""
select count(distinct ttl) as titles, count(distinct ttl || ':' || paragraph) as paragraphs, count(*) as questions
from placed""", "f_qa", **DOCUMENTS),
    "to_examples": fx.sql("""
select ttl as title, md5(max(context)) as context, count(*) as questions, false as impossible
from placed where paragraph = 0 group by ttl""", "f_qa", **DOCUMENTS),
    "merge_transcripts": fx.sql("select doc_id, context_id, md5(context) as digest from merged",
                                "f_contexts", "f_responses", merged=_MERGED),
    "merge_stats": fx.sql("select count(*) as questions, count(context) as with_context from merged",
                          "f_contexts", "f_responses", merged=_MERGED),
}
