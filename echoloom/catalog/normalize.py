"""Normalising, reading and setting fields by path; answer normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions import variants
from echoloom.functions.text import normalize_answer as normal
from echoloom.operators import normalize as ops
from echoloom.session import scratch_dir
from echoloom.sinks import files as sinks
from echoloom.sources import files


def normalize_field(spark, sf):
    done = ops.normalize_field(fx.contexts(spark, sf), "context")
    return done.select("doc_id", F.md5("context").alias("digest"))


def normalize_array_field(spark, sf):
    done = ops.normalize_field(fx.qa(spark, sf), "answers.text")
    return done.select("uit_id", F.array_join("answers.text", "|").alias("texts"),
                       F.size("answers.answer_start").alias("starts"))


def nested_get_set(spark, sf):
    rows = fx.qa(spark, sf)
    first = F.get(ops.get_nested(rows, "answers.text"), F.lit(0))
    made = ops.set_nested(rows, "meta.origin.first", first)
    made = ops.set_nested(made, "answers.note", F.concat(F.lit("n"), "turn"))
    made = ops.set_nested(made, "question.words", F.length("question"))
    return made.select(
        "uit_id", ops.get_nested(made, "meta.origin.first").alias("origin"),
        ops.get_nested(made, "answers.note").alias("note"),
        ops.get_nested(made, "question.words").alias("words"),
        F.size(ops.get_nested(made, "answers.text")).alias("texts"),
        ops.get_nested(made, "title.missing").isNull().alias("absent"))


def normalize_answer(spark, sf):
    return fx.contexts(spark, sf).select("doc_id", F.md5(normal("context")).alias("digest"))


def _mixed_lines(spark, sf):
    """Lines whose ``body.context`` is text, a list with text, a number, or not there; every row has a key of its own."""
    kind = F.col("doc_id") % 4
    quoted = F.to_json(F.array("context"))
    text = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    body = (F.when(kind == 0, F.concat(F.lit('{"context":['), text, F.lit(',7,null,"B C"],"n":1}')))
            .when(kind == 1, F.lit('{"context":12.5}')).when(kind == 2, F.lit('"no object"'))
            .otherwise(F.concat(F.lit('{"context":'), text, F.lit("}"))))
    line = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"body":'), body, F.lit(',"only_'), "doc_id",
                    F.lit('":{"k":[1,{}]}}'))
    path = scratch_dir(spark, "mixed")
    fx.contexts(spark, sf).select(F.when(F.col("doc_id") % 7 == 0, F.concat(line, F.lit(" x"))).otherwise(line)
                                  .alias("value")).write.text(path)
    return path


def normalize_variant_field(spark, sf):
    """Each row by its own type; keys that no other row has pass through."""
    good, _ = files.read_jsonl_lenient(spark, _mixed_lines(spark, sf))
    done = ops.normalize_field(good, "record.body.context")
    doc_id = F.try_variant_get("record", "$.doc_id", "bigint")
    held = ops.get_nested(done, "record.body.context")
    listed = variants.items(held)
    text = F.coalesce(variants.as_text(held), F.array_join(F.transform(listed, variants.to_line), "|"),
                      variants.to_line(held))
    own = variants.items(variants.get_path(F.col("record"), "body.missing"))
    return done.select(doc_id.alias("doc_id"), F.md5(text).alias("digest"), own.isNull().alias("absent"),
                       variants.to_line(F.col("record")).contains(F.concat(F.lit('"only_'), doc_id, F.lit('":{"k":[1,{}]}')))
                       .alias("own_key"))


def set_variant_field(spark, sf):
    """Read, set a field below missing and wrong parents, write, read again."""
    good, bad = files.read_jsonl_lenient(spark, _mixed_lines(spark, sf))
    doc_id = F.try_variant_get("record", "$.doc_id", "bigint")
    made = ops.set_nested(good, "record.body.origin.id", F.concat(F.lit("o"), doc_id))
    made = ops.set_nested(made, "record.tags", F.array(F.lit("a"), doc_id.cast("string")))
    path = scratch_dir(spark, "variant-records")
    sinks.write_records(made, path)
    back, _ = files.read_jsonl_lenient(spark, path)
    get = lambda p: ops.get_nested(back, f"record.{p}")
    rows = back.select(
        doc_id.alias("doc_id"), variants.as_text(get("body.origin.id")).alias("origin"),
        F.array_join(F.transform(variants.items(get("tags")), variants.as_text), "|").alias("tags"),
        get("body.context").isNotNull().alias("context"), get("body.n").isNotNull().alias("n"))
    rejected = bad.select(F.regexp_extract("line", r'^\{"doc_id":(\d+),', 1).cast("bigint").alias("doc_id"))
    return rows.unionByName(rejected, allowMissingColumns=True)


QUERIES = {
    "normalize_field": normalize_field, "normalize_array_field": normalize_array_field,
    "nested_get_set": nested_get_set, "normalize_answer": normalize_answer,
    "normalize_variant_field": normalize_variant_field, "set_variant_field": set_variant_field,
}

ORACLE = {
    "normalize_field": fx.sql(f"select doc_id, md5({fx.simple_normal_sql('context')}) as digest from f_contexts",
                              "f_contexts"),
    "normalize_array_field": fx.sql(f"""
select uit_id, {fx.simple_normal_sql('a1')} || '|' || {fx.simple_normal_sql('a2')} as texts,
  len(answers.answer_start) as starts from f_qa""", "f_qa"),
    "nested_get_set": fx.sql("""
select uit_id, a1 as origin, 'n' || turn as note, length(question) as words, 2 as texts, true as absent
from f_qa""", "f_qa"),
    "normalize_variant_field": fx.sql(f"""
select doc_id, md5(case doc_id % 4
    when 0 then to_json({fx.simple_normal_sql('context')})::varchar || '|7|null|"b c"'
    when 1 then '12.5' when 3 then {fx.simple_normal_sql('context')} end) as digest, true as absent, true as own_key
from f_contexts where doc_id % 7 <> 0""", "f_contexts"),
    "set_variant_field": fx.sql("""
select doc_id, case when doc_id % 7 <> 0 then 'o' || doc_id end as origin,
  case when doc_id % 7 <> 0 then 'a|' || doc_id end as tags,
  case when doc_id % 7 <> 0 then doc_id % 4 <> 2 end as context, case when doc_id % 7 <> 0 then doc_id % 4 = 0 end as n
from f_contexts""", "f_contexts"),
    "normalize_answer": fx.sql(f"select doc_id, md5({fx.normal_sql('context')}) as digest from f_contexts",
                               "f_contexts"),
}
