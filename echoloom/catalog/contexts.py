"""Context dictionary: strip, ids, distinct, lookups, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions.text import content_id, is_blank, preview, py_strip
from echoloom.operators import contexts as ops


def _digest(c="context"):
    return F.md5(c).alias("digest")


def _padded(spark, sf):
    """Text between blanks of several kinds; every tenth text is blank altogether."""
    left, right = "　 \t\x1c", "\xa0\n \x0b"
    text = F.when(F.col("doc_id") % 10 == 3, F.lit(left + right)).otherwise(
        F.concat(F.lit(left), "text", F.lit(right)))
    return fx.table(spark, sf, "documents").select("doc_id", text.alias("context"))


def py_strip_(spark, sf):
    stripped = _padded(spark, sf).withColumn("context", py_strip("context"))
    return stripped.select("doc_id", F.length("context").alias("n"), _digest())


def contexts_nonblank(spark, sf):
    return ops.nonblank(_padded(spark, sf)).select("doc_id", _digest())


def context_ids(spark, sf):
    return fx.contexts(spark, sf).select("doc_id", content_id(py_strip("context")).alias("context_id"))


def text_preview(spark, sf):
    return fx.contexts(spark, sf).select("doc_id", preview("context").alias("preview"),
                                         preview("context", 50, always=True).alias("warning"))


def _requests(spark, sf):
    """Question records that ask for a context by id, a third of them unknown to the dictionary."""
    return fx.contexts(spark, sf).select("doc_id", content_id("context").alias("context_id"))


def distinct_contexts(spark, sf):
    return ops.distinct_contexts(fx.contexts(spark, sf), "doc_id").select("context_id", _digest(), "first_seen")


def distinct_ids(spark, sf):
    return ops.distinct_ids(_requests(spark, sf))


def id_collisions(spark, sf):
    """Short ids, so that collisions occur in small tables."""
    short = fx.contexts(spark, sf).select("context").distinct().select(
        content_id("context", 2).alias("context_id"))
    return ops.id_collisions(short)


def last_wins_map(spark, sf):
    pairs = fx.contexts(spark, sf).select("title", F.col("context").alias("value"), "doc_id")
    return ops.last_wins(pairs, "title", "value", "doc_id").select("title", _digest("value"))


def first_seen(spark, sf):
    rows = fx.contexts(spark, sf).select("title", "doc_id", "split", F.md5("context").alias("digest"))
    return ops.first_seen(rows, "title", "doc_id")


def _replaced(spark, sf):
    return ops.replace_contexts(fx.contexts(spark, sf), fx.dictionary(spark, sf))


def replace_contexts(spark, sf):
    return _replaced(spark, sf).select("doc_id", "context_id", _digest(), "known")


def replace_stats(spark, sf):
    return ops.replace_stats(_replaced(spark, sf))


def contexts_to_process(spark, sf):
    known = ops.last_wins(fx.dictionary(spark, sf), "context_id", "context", "context")
    return ops.contexts_to_process(_requests(spark, sf), known).select("context_id", _digest())


def unresolved_ids(spark, sf):
    return ops.unresolved_ids(_requests(spark, sf), fx.dictionary(spark, sf))


def filter_by_ids(spark, sf):
    return ops.filter_by_ids(_requests(spark, sf), fx.dictionary(spark, sf).select("context_id"))


def limit_contexts(spark, sf):
    known = fx.dictionary(spark, sf).select("context_id", _digest())
    return ops.limit_contexts(known, 100)


def split_counts(spark, sf):
    return fx.contexts(spark, sf).groupBy("split").agg(F.count("*").alias("records"),
                                                       F.count_if(is_blank("context")).alias("blank"))


QUERIES = {
    "py_strip": py_strip_, "contexts_nonblank": contexts_nonblank, "context_ids": context_ids,
    "text_preview": text_preview, "distinct_contexts": distinct_contexts, "distinct_ids": distinct_ids,
    "id_collisions": id_collisions, "last_wins_map": last_wins_map, "first_seen": first_seen,
    "replace_contexts": replace_contexts, "replace_stats": replace_stats,
    "contexts_to_process": contexts_to_process, "unresolved_ids": unresolved_ids,
    "filter_by_ids": filter_by_ids, "limit_contexts": limit_contexts, "split_counts": split_counts,
}

_PADDED = """select doc_id, case when doc_id % 10 = 3
    then chr(12288) || ' ' || chr(9) || chr(28) || chr(160) || chr(10) || chr(8195) || chr(11)
    else chr(12288) || ' ' || chr(9) || chr(28) || text || chr(160) || chr(10) || chr(8195) || chr(11) end as context
  from documents"""
_REQUESTS = "select doc_id, concat('ctx_', substr(md5(context), 1, 8)) as context_id from f_contexts"
_REPLACED = f"""
select c.*, d.context_id, d.context_id is not null as hit, length({fx.strip_sql('c.context')}) > 0 as filled
from f_contexts c left join f_dict d on {fx.strip_sql('c.context')} = d.context"""

ORACLE = {
    "py_strip": fx.sql(f"""
select doc_id, length(s) as n, md5(s) as digest from (select doc_id, {fx.strip_sql('context')} as s from padded)""",
                       padded=_PADDED),
    "contexts_nonblank": fx.sql(f"""
select doc_id, md5(s) as digest from (select doc_id, {fx.strip_sql('context')} as s from padded) where s <> ''""",
                                padded=_PADDED),
    "context_ids": fx.sql(f"select doc_id, {fx.id_sql(fx.strip_sql('context'))} as context_id from f_contexts",
                          "f_contexts"),
    "text_preview": fx.sql("""
select doc_id, case when length(context) > 100 then substr(context, 1, 100) || '...' else context end as preview,
  substr(context, 1, 50) || '...' as warning
from f_contexts""", "f_contexts"),
    "distinct_contexts": fx.sql(f"""
select {fx.id_sql('s')} as context_id, md5(s) as digest, min(doc_id) as first_seen
from (select doc_id, {fx.strip_sql('context')} as s from f_contexts) where s <> '' group by s""", "f_contexts"),
    "distinct_ids": fx.sql("select distinct context_id from requests", "f_contexts", requests=_REQUESTS),
    "id_collisions": fx.sql("""
select context_id, count(*) as contexts
from (select distinct context, concat('ctx_', substr(md5(context), 1, 2)) as context_id from f_contexts)
group by context_id having count(*) > 1""", "f_contexts"),
    "last_wins_map": fx.sql("""
select title, md5(arg_max(context, doc_id)) as digest from f_contexts where title is not null group by title""",
                            "f_contexts"),
    "first_seen": fx.sql("""
select title, doc_id, split, md5(context) as digest from (
  select *, row_number() over (partition by title order by doc_id) as n from f_contexts) where n = 1""",
                         "f_contexts"),
    "replace_contexts": fx.sql("""
select doc_id, context_id, case when not hit then md5(context) end as digest, case when filled then hit end as known
from replaced""", "f_dict", replaced=_REPLACED),
    "replace_stats": fx.sql("""
select count(*) filter (filled and hit) as replaced, count(*) filter (filled and not hit) as missed,
  count(*) filter (not filled) as blank from replaced""", "f_dict", replaced=_REPLACED),
    "contexts_to_process": fx.sql("""
select context_id, md5(max(context)) as digest from f_dict
where context_id in (select context_id from requests) group by context_id""", "f_dict", requests=_REQUESTS),
    "unresolved_ids": fx.sql("""
select distinct context_id from requests where context_id not in (select context_id from f_dict)""",
                             "f_dict", requests=_REQUESTS),
    "filter_by_ids": fx.sql("""
select doc_id, context_id from requests where context_id in (select context_id from f_dict)""",
                            "f_dict", requests=_REQUESTS),
    "limit_contexts": fx.sql("""
select context_id, md5(context) as digest from f_dict order by context_id, digest limit 100""", "f_dict"),
    "split_counts": fx.sql(f"""
select split, count(*) as records, count(*) filter ({fx.strip_sql('context')} = '') as blank
from f_contexts group by split""", "f_contexts"),
}
