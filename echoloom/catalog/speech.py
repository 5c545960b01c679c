"""Routing, recognition results, voices and media references."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions.text import content_id
from echoloom.operators import speech as ops

BASE = "/audio/en"


def id_from_path(spark, sf):
    return fx.media(spark, sf).select("doc_id", ops.id_from_path("path").alias("context_id"))


def route_requests(spark, sf):
    return fx.media(spark, sf).select("doc_id", ops.staged("size_bytes", "duration_s").alias("staged"))


def route_reason(spark, sf):
    files = fx.media(spark, sf).withColumn("staged", ops.staged("size_bytes", "duration_s"))
    both = files.join(fx.responses(spark, sf).select("doc_id", "error"), "doc_id")
    return both.select("doc_id", ops.staging_reason("size_bytes", "duration_s").alias("reason"),
                       ops.retry_staged("staged", "error").alias("retry"))


def flatten_hypotheses(spark, sf):
    flat = ops.flatten_hypotheses(fx.responses(spark, sf))
    words = F.transform(F.flatten("all_alternatives"), lambda a: a["transcript"])
    return flat.select("doc_id", F.md5("transcription").alias("digest"), "empty_result",
                       F.size("all_alternatives").alias("segments"),
                       F.md5(F.array_join(words, "|")).alias("alternatives"))


def _lines(spark, sf):
    return fx.responses(spark, sf).transform(ops.flatten_hypotheses)


def transcript_lines(spark, sf):
    lines = ops.transcript_lines(_lines(spark, sf), keep=("doc_id",))
    return lines.select("doc_id", "context_id", F.md5("context").alias("digest"), "empty_result", "error", "status")


def batch_summary(spark, sf):
    summary = ops.batch_summary(ops.transcript_lines(_lines(spark, sf)))
    return summary.withColumns({c: F.round(c, 4) for c in ("total_time", "avg_time_per_file")})


def voice_types(spark, sf):
    return fx.voices(spark, sf).select("idx", "voice_name", ops.voice_type("voice_name").alias("voice_type"))


def _texts(spark, sf):
    return fx.contexts(spark, sf).select("context").distinct().select(
        content_id("context").alias("context_id"), "context")


def assign_voices(spark, sf):
    return ops.assign(_texts(spark, sf), fx.voices(spark, sf), "context_id", 7).select(
        "context_id", F.md5("context").alias("digest"), "voice_name", "voice_gender")


def synthesis_metadata(spark, sf):
    return ops.synthesis_metadata(_texts(spark, sf), fx.voices(spark, sf), 7, F.lit(0.0))


def _resolved(spark, sf):
    return ops.resolve_media(fx.refs(spark, sf), fx.media(spark, sf), BASE)


def resolve_media(spark, sf):
    return ops.resolved_media(_resolved(spark, sf)).select("doc_id", "media_path")


def missing_media(spark, sf):
    return ops.missing_media(_resolved(spark, sf)).select(
        "doc_id", F.coalesce("context_id", F.lit("-")).alias("context_id"), "wanted")


QUERIES = {
    "id_from_path": id_from_path, "route_requests": route_requests, "route_reason": route_reason,
    "flatten_hypotheses": flatten_hypotheses, "transcript_lines": transcript_lines,
    "batch_summary": batch_summary, "voice_types": voice_types, "assign_voices": assign_voices,
    "synthesis_metadata": synthesis_metadata, "resolve_media": resolve_media, "missing_media": missing_media,
}

_STAGED = "(size_bytes > 10485760 or coalesce(duration_s > 60, false))"
_FLAT = """
select *, case when error is null then list_filter(list_transform(results, lambda r: r.alternatives),
    lambda a: len(a) > 0) end as alts from f_responses"""
_LINES = """
select *, case when error is null
    then coalesce(array_to_string(list_transform(alts, lambda a: a[1].transcript), ' '), '') end as transcription,
  coalesce(len(alts) = 0, true) as empty_result from flat"""
_VOICE_TYPE = ("case when contains(voice_name, 'Neural') or contains(voice_name, 'Wavenet') "
               "or contains(voice_name, 'HD') then 'NEURAL' else 'STANDARD' end")
_TEXTS = f"select distinct {fx.id_sql('context')} as context_id, context from f_contexts"
_CAST = f"""
select t.*, v.* from texts t join f_voices v
  on v.idx = {fx.pick_sql('t.context_id', 7, '(select count(*) from f_voices)')}"""
_ASKED = f"""
select *, case when named is null then null when starts_with(named, '/') then named
    else '{BASE}/' || named end as wanted
from (select *, coalesce(nullif(audio_path, ''), nullif(file_path, ''), nullif(audio_file, '')) as named from f_refs)"""
_FILES = """
select distinct path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, lower(regexp_extract(path, '([^/]*)$', 1)) as low
from f_media"""
_RESOLVED = f"""
select a.*, coalesce(
    (select path from files f where f.path = a.wanted),
    (select min(path) from files f where f.dir = regexp_extract(a.wanted, '^(.*)/[^/]*$', 1)
        and f.low = lower(regexp_extract(a.wanted, '([^/]*)$', 1))),
    case when a.wanted is null then (select path from files f where f.path = '{BASE}/' || a.context_id || '.wav') end,
    case when a.wanted is null then (select path from files f where f.path = '{BASE}/' || a.context_id || '.mp3') end
  ) as media_path
from asked a"""
_MEDIA = {"files": _FILES, "asked": _ASKED, "resolved": _RESOLVED}

ORACLE = {
    "id_from_path": fx.sql(r"""
select doc_id, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '') as context_id from f_media""",
                           "f_media"),
    "route_requests": fx.sql(f"select doc_id, {_STAGED} as staged from f_media", "f_media"),
    "route_reason": fx.sql(f"""
select m.doc_id, case when size_bytes > 10485760
      then printf('file size %.2fMB > 10MB', round_even(size_bytes / 1048576.0::double, 2))
    when duration_s > 60 then printf('duration %.2fs > 60s', round_even(duration_s, 2))
    else 'as a precaution' end as reason,
  not {_STAGED} and coalesce(contains(lower(error), 'audio exceeds duration limit'), false) as retry
from f_media m join f_responses r on m.doc_id = r.doc_id""", "f_media", "f_responses"),
    "flatten_hypotheses": fx.sql("""
select doc_id, md5(transcription) as digest, empty_result, len(alts) as segments,
  md5(array_to_string(list_transform(flatten(alts), lambda a: a.transcript), '|')) as alternatives
from lines""", "f_responses", flat=_FLAT, lines=_LINES),
    "transcript_lines": fx.sql("""
select doc_id, context_id, case when error is null then md5(case when empty_result then '' else transcription end) end
    as digest,
  case when error is null and empty_result then true end as empty_result, error,
  case when error is not null then 'failed' when empty_result then 'empty' else 'success' end as status
from lines""", "f_responses", flat=_FLAT, lines=_LINES),
    "batch_summary": fx.sql("""
select count(*) filter (error is null and not empty_result) as success_count,
  count(*) filter (error is null and empty_result) as empty_count,
  count(*) filter (error is not null) as failed_count, count(*) as total_files,
  round(sum(processing_time), 4) as total_time, round(avg(processing_time), 4) as avg_time_per_file
from lines""", "f_responses", flat=_FLAT, lines=_LINES),
    "voice_types": fx.sql(f"select idx, voice_name, {_VOICE_TYPE} as voice_type from f_voices", "f_voices"),
    "assign_voices": fx.sql("""
select context_id, md5(context) as digest, voice_name, voice_gender from casting""",
                            "f_contexts", "f_voices", texts=_TEXTS, casting=_CAST),
    "synthesis_metadata": fx.sql(f"""
select context_id, context_id || '.mp3' as audio_file, voice_name, voice_gender, {_VOICE_TYPE} as voice_type,
  0.0::double as timestamp, length(context) as context_length from casting""",
                                 "f_contexts", "f_voices", texts=_TEXTS, casting=_CAST),
    "resolve_media": fx.sql("select doc_id, media_path from resolved where media_path is not null",
                            "f_refs", **_MEDIA),
    "missing_media": fx.sql("""
select doc_id, coalesce(context_id, '-') as context_id, wanted from resolved
where media_path is null and wanted is not null""", "f_refs", **_MEDIA),
}
