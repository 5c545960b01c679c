"""Readers on files that Spark first writes from the test tables."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions.text import basename, dirname
from echoloom.operators import qa as qa_ops
from echoloom.session import scratch_dir
from echoloom.sinks import files as sinks
from echoloom.sources import files, media

RECORD = "doc_id bigint, context string, title string, split string"


def _digest():
    return F.md5("context").alias("digest")


def scan_jsonl_strict(spark, sf):
    path = scratch_dir(spark, "jsonl")
    sinks.write_jsonl(fx.contexts(spark, sf), path)
    return files.read_jsonl(spark, path, RECORD).select("doc_id", "title", "split", _digest())


def scan_jsonl_lenient(spark, sf):
    """A tenth of the lines is cut short, and a blank line follows some others."""
    path = scratch_dir(spark, "lenient")
    rows = fx.contexts(spark, sf)
    line = F.to_json(F.struct("doc_id", "context", "title", "split"))
    kind = F.col("doc_id") % 10
    text = F.when(kind == 0, F.left(line, F.length(line) - 3)).when(kind == 1, F.concat(line, F.lit("\n \n")))
    rows.select(text.otherwise(line).alias("value")).write.text(path)
    good, bad = files.read_jsonl_lenient(spark, path, RECORD)
    return good.select("doc_id", F.lit("good").alias("kind"), _digest()).unionByName(bad.select(
        F.regexp_extract("line", r'^\{"doc_id":(\d+),', 1).cast("bigint").alias("doc_id"),
        F.lit("reject").alias("kind"), F.lit("").alias("digest")))


def scan_json_wrapped(spark, sf):
    """Two lists per document, and documents that are a record themselves."""
    path = scratch_dir(spark, "wrapped")
    rows = fx.contexts(spark, sf)
    record = F.struct("doc_id", "context", "title", "split")
    listed = lambda split: F.collect_list(F.when(F.col("split") == split, record))
    wrapped = rows.where(F.col("split") != "test").groupBy(F.floor(F.col("doc_id") / 20).alias("g")).agg(
        listed("train").alias("data"), listed("validation").alias("train"))
    lines = wrapped.select(F.to_json(F.struct("data", "train")).alias("value")).unionByName(
        rows.where(F.col("split") == "test").select(F.to_json(record).alias("value")))
    lines.write.text(path)
    return files.read_json_records(spark, path, RECORD, layout="lines").select("doc_id", "title", "split", _digest())


def scan_json_document(spark, sf):
    """One document in parts: two lists of records, whose own fields are named like wrappers."""
    path = scratch_dir(spark, "one-document")
    rows = fx.contexts(spark, sf)
    own = F.array(F.struct(F.lit(-1).alias("doc_id")))
    record = F.struct("doc_id", "context", "title", "split", own.alias("items"), own.alias("data"))
    section = F.when(F.col("split") == "train", 0).otherwise(1)
    sinks.write_document(rows.select(section.alias("section"), F.col("doc_id").alias("order"),
                                     F.to_json(record).alias("json")), path,
                         ['{"version":"1,0","other":[1,2],"data":[', '],"test":[', '],"more":{"train":[{}]}}'])
    return files.read_json_records(spark, path, RECORD).select("doc_id", "title", "split", _digest())


def scan_contexts_json(spark, sf):
    path = scratch_dir(spark, "contexts")
    known = fx.contexts(spark, sf).select(fx.content_id("context").alias("context_id"), "context", "doc_id")
    sinks.write_contexts_json(known, path, "doc_id", layout="lines", per_document=100)
    return files.read_contexts(spark, path, layout="lines").select("context_id", _digest())


def load_id_set(spark, sf):
    path = scratch_dir(spark, "ids")
    asked = fx.contexts(spark, sf).select(
        F.when(F.col("doc_id") % 10 != 0, fx.content_id("context")).alias("context_id"), "doc_id")
    sinks.write_contexts_json(asked, path, "doc_id", layout="lines", per_document=100)
    return files.read_id_set(spark, path, layout="lines")


def scan_splits(spark, sf):
    rows = fx.contexts(spark, sf)
    paths = {}
    for split in ("train", "validation", "test"):
        paths[split] = scratch_dir(spark, split)
        sinks.write_jsonl(rows.where(F.col("split") == split).drop("split"), paths[split])
    return files.read_splits(spark, paths, "doc_id bigint, context string, title string").select(
        "doc_id", "split", _digest())


def _text_files(spark, sf):
    """The texts as files in one folder per language, uncompressed."""
    path = scratch_dir(spark, "files")
    fx.table(spark, sf, "documents").select("lang", F.col("text").alias("value")).write.option(
        "compression", "none").partitionBy("lang").text(path)
    return path


def _bytes_by_folder(listing):
    return listing.groupBy(basename(dirname("path")).alias("folder")).agg(F.sum("length").alias("bytes"))


def list_media(spark, sf):
    return _bytes_by_folder(media.list_media(spark, _text_files(spark, sf), ".TXT"))


def list_media_flat(spark, sf):
    path = _text_files(spark, sf)
    flat = media.list_media(spark, f"{path}/lang=en", ".txt", recursive=False, ignore_case=False)
    upper = media.list_media(spark, f"{path}/lang=en", ".TXT", recursive=False, ignore_case=False)
    nested = media.list_media(spark, path, ".txt", recursive=False, ignore_case=False)
    return _bytes_by_folder(flat.unionByName(upper).unionByName(nested))


def scan_qa_document(spark, sf):
    path = scratch_dir(spark, "qa")
    sinks.write_qa_documents(qa_ops.nest(fx.qa(spark, sf), "ord"), path, layout="lines")
    rows = qa_ops.flatten_documents(files.read_qa_documents(spark, path, layout="lines"))
    return rows.select("title", "id", F.md5("context").alias("context"), F.md5("question").alias("question"),
                       F.array_join("answers.text", "|").alias("answers"))


def scan_predictions(spark, sf):
    path = scratch_dir(spark, "predictions")
    fx.predictions(spark, sf).select(F.to_json(F.create_map("id", "prediction")).alias("value")).write.text(path)
    return files.read_predictions(spark, path, layout="lines")


def wav_bytes(samples: list[float], rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"".join(int(32767 * max(-1.0, min(1.0, v))).to_bytes(2, "little", signed=True)
                               for v in samples))
    return out.getvalue()


def media_duration(spark, sf):
    """The signals as WAV bytes at three rates; every seventh is no WAV file."""
    rows = fx.signals(spark, sf).withColumn("rate", F.get(
        F.array(F.lit(8000), F.lit(16000), F.lit(44100)), (F.col("vec_id") % 3).cast("int")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [b"no audio" if v % 7 == 0 else wav_bytes(x, r) for v, x, r in zip(b["vec_id"], b["x"], b["rate"])]
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": made})

    encoded = rows.select("vec_id", "x", "rate").mapInPandas(encode, "path string, content binary")
    return media.media_duration(encoded).withColumn("duration_s", F.round("duration_s", 9))


QUERIES = {
    "scan_jsonl_strict": scan_jsonl_strict, "scan_jsonl_lenient": scan_jsonl_lenient,
    "scan_json_wrapped": scan_json_wrapped, "scan_json_document": scan_json_document, "scan_contexts_json": scan_contexts_json,
    "load_id_set": load_id_set, "scan_splits": scan_splits, "list_media": list_media,
    "list_media_flat": list_media_flat, "scan_qa_document": scan_qa_document,
    "scan_predictions": scan_predictions, "media_duration": media_duration,
}

_ROWS = "select doc_id, title, split, md5(context) as digest from f_contexts"
_BYTES = "sum(octet_length(encode(text)) + 1)::bigint as bytes from documents"

ORACLE = {
    "scan_jsonl_strict": fx.sql(_ROWS, "f_contexts"),
    "scan_jsonl_lenient": fx.sql("""
select doc_id, case when doc_id % 10 = 0 then 'reject' else 'good' end as kind,
  case when doc_id % 10 = 0 then '' else md5(context) end as digest from f_contexts""", "f_contexts"),
    "scan_json_wrapped": fx.sql(_ROWS, "f_contexts"),
    "scan_json_document": fx.sql(_ROWS, "f_contexts"),
    "scan_contexts_json": fx.sql(f"""
select {fx.id_sql('context')} as context_id, md5(context) as digest from f_contexts""", "f_contexts"),
    "load_id_set": fx.sql(f"""
select distinct {fx.id_sql('context')} as context_id from f_contexts where doc_id % 10 <> 0""", "f_contexts"),
    "scan_splits": fx.sql("select doc_id, split, md5(context) as digest from f_contexts", "f_contexts"),
    "list_media": f"select 'lang=' || lang as folder, {_BYTES} group by lang",
    "list_media_flat": f"select 'lang=' || lang as folder, {_BYTES} where lang = 'en' group by lang",
    "scan_qa_document": fx.sql("""
select coalesce(title, 'Untitled') as title, coalesce(id, uit_id) as id, md5(context) as context,
  md5(question) as question, case when a2 = '' then a1 when a1 = '' then a2 else a1 || '|' || a2 end as answers
from f_qa where len(answers.answer_start) = 2 and (a1 <> '' or a2 <> '')""", "f_qa"),
    "scan_predictions": fx.sql("select id, prediction from f_predictions", "f_predictions"),
    "media_duration": fx.sql("""
select vec_id::varchar as path,
  case when vec_id % 7 <> 0 then round(len(x) / ([8000, 16000, 44100][vec_id % 3 + 1])::double, 9) end as duration_s
from f_signals""", "f_signals"),
}
