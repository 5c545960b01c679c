"""Whole jobs: the dataset build and the evaluation of nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import evaluate as scored
from echoloom.catalog import fixtures as fx
from echoloom.catalog import scoring
from echoloom.catalog.qa import DOCUMENTS
from echoloom.functions.text import content_id
from echoloom.operators import qa as qa_ops
from echoloom.operators import scoring as scoring_ops
from echoloom.plans import build, evaluate
from echoloom.session import materialize

RECORD = ("id", "uit_id", "title", "context", "question", "answers", "ord")


def _responses(rows):
    """One segment per sentence; a sixteenth failed, a sixteenth empty."""
    segment = lambda s: F.struct(F.array(F.struct(
        s.alias("transcript"), F.lit(0.9).alias("confidence"))).alias("alternatives"))
    ident = content_id("context")
    found = F.transform(F.split("context", r"\."), segment)
    kind = F.substring(ident, 5, 1)
    return rows.select(
        "ord", ident.alias("context_id"), F.concat(ident, F.lit(".wav")).alias("file_name"),
        F.when(kind == "1", F.slice(found, 1, 0)).when(kind != "0", found).alias("results"),
        F.when(kind == "0", "failed").alias("error"), F.lit(1.0).alias("processing_time"))


def build_documents(spark, sf):
    records = materialize(fx.qa(spark, sf).select(*RECORD), "records")
    made = build.build(records, _responses(records), "ord", "ord")
    return qa_ops.flatten_documents(made).select("title", "id", F.md5("context").alias("context"),
                                                 F.md5("question").alias("question"), F.size("answers").alias("n"))


def synthesis_plan(spark, sf):
    records = fx.qa(spark, sf).select(*RECORD)
    dictionary, questions = build.prepare(records, "ord")
    return build.plan_synthesis(questions, dictionary, fx.voices(spark, sf), seed=3).select(
        "context_id", "audio_file", "voice_name", "voice_type", "context_length")


def _documents(spark, sf):
    return materialize(qa_ops.nest(fx.qa(spark, sf), "ord"), "documents")


def report_documents(spark, sf):
    """Reads nested documents; predictions are by ``uit_id``, which is the id where one is given."""
    report = evaluate.report(_documents(spark, sf), fx.predictions(spark, sf))
    return report.withColumns({c: F.round(c, 6) for c in ("exact_match", "f1")})


def judge_answers(spark, sf):
    """Answers of the stand-in scorer to first paragraphs, judged against these questions."""
    documents = _documents(spark, sf)
    ranked = evaluate.predict(documents, scoring.lexical_scorer, n_best=1, max_seq_length=64, doc_stride=16,
                              max_query_length=16)
    examples = qa_ops.to_examples(documents)
    return evaluate.judge(examples, scoring_ops.best_predictions(ranked, evaluate.questions(documents)))


QUERIES = {"build_documents": build_documents, "synthesis_plan": synthesis_plan,
           "report_documents": report_documents, "judge_answers": judge_answers}

_HEARD = f"""
select *, {fx.id_sql(fx.strip_sql('context'))} as cid, {fx.id_sql('context')} as rid, substr(md5(context), 1, 1) as kind
from f_qa"""
_LINES = f"""
select rid as lid, case when kind = '1' then '' else {fx.simple_normal_sql("replace(context, '.', ' ')")} end as text
from (select rid, kind, arg_max(context, ord) as context from heard where kind <> '0' group by rid, kind)"""


_FIRST = """
select qid as id, question, context, pairs[1].t as truth from placed where paragraph = 0"""

ORACLE = {
    "judge_answers": fx.sql(f"""
select {scored.COUNTS} from (
  select case when p = t then 'correct' when contains(t, p) or contains(p, t) then 'similar' else 'incorrect' end
    as verdict
  from (select {fx.strip_sql('truth')} as t, {fx.strip_sql("coalesce(text, '')")} as p
    from first_ left join answers_ on first_.id = answers_.id))""", "f_qa", **DOCUMENTS, first_=_FIRST,
                            **scoring.answers_sql("select id, question, context from first_", 1)),
    "build_documents": fx.sql("""
select coalesce(title, 'Untitled') as title, coalesce(id, uit_id) as id, md5(text) as context,
  md5(question) as question, (a1 <> '')::int + (a2 <> '')::int as n
from heard join lines on cid = lid
where text <> '' and len(answers.answer_start) = 2 and (a1 <> '' or a2 <> '')""",
                              "f_qa", heard=_HEARD, lines=_LINES),
    "synthesis_plan": fx.sql(f"""
select t.cid as context_id, t.cid || '.mp3' as audio_file, voice_name,
  case when contains(voice_name, 'Neural') or contains(voice_name, 'Wavenet') or contains(voice_name, 'HD')
    then 'NEURAL' else 'STANDARD' end as voice_type, length(t.text) as context_length
from (select cid, arg_max({fx.strip_sql('context')}, ord) as text from heard group by cid) t
join f_voices v on v.idx = {fx.pick_sql('t.cid', 3, '(select count(*) from f_voices)')}""",
                             "f_qa", "f_voices", heard=_HEARD),
    "report_documents": fx.sql("""
select count(*) as questions, count(*) filter (answered) as answered, 0::bigint as rejected,
  round(100.0 * sum(exact_match) / count(*), 6) as exact_match, round(100.0 * sum(f1) / count(*), 6) as f1
from scores s join f_qa q on s.id = q.uit_id
where len(q.answers.answer_start) = 2 and (a1 <> '' or a2 <> '')""", "f_qa", "f_predictions", **scored.SCORED),
}
