"""Chunks, answer positions, n-best spans and injected scorers."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.operators import features as feature_ops
from echoloom.operators import qa as qa_ops
from echoloom.operators import scoring as ops


def chunk_contexts(spark, sf):
    chunks = ops.chunk_contexts(fx.contexts(spark, sf).select("doc_id", "context"))
    return chunks.select("doc_id", "chunk", "start", F.size("words").alias("n"),
                         F.md5(F.array_join("words", " ")).alias("digest"))


def chunk_answer_spans(spark, sf):
    rows = fx.qa(spark, sf).select("uit_id", "context", F.posexplode(qa_ops.zip_answers("answers")).alias("i", "a"))
    spans = ops.chunk_answer_spans(
        rows.select("uit_id", "i", "context", F.col("a.text").alias("answer"), "a.answer_start"), 32, 16)
    return spans.select("uit_id", "i", "chunk", "start", "start_position", "end_position")


PIECE, IDS, FIRST_ID = 4, 30_000, 10


def piece_tokenizer(words: list[str]) -> list[list[tuple[int, int]]]:
    """A stand-in for a vocabulary: pieces of four characters, their ids from a digest."""
    def token(piece: str) -> tuple[int, int]:
        return int(hashlib.md5(piece.encode()).hexdigest()[:6], 16) % IDS + FIRST_ID, len(piece)

    return [[token(w[i:i + PIECE]) for i in range(0, len(w), PIECE)] for w in words]


def model_inputs(spark, sf):
    rows = fx.qa(spark, sf).select("uit_id", "question", "context", F.col("a1").alias("answer"),
                                   F.lit(0).alias("answer_start"))
    made = feature_ops.model_inputs(rows, piece_tokenizer, feature_ops.Special(1, 2, 0), 96, 32, 24)
    digest = lambda name: F.md5(F.array_join(name, ",")).alias(name)
    return made.select("uit_id", "chunk", *map(digest, ("input_ids", "attention_mask", "token_type_ids", "p_mask")),
                       "cls_index", "is_impossible", "start_position", "end_position",
                       F.size("token_ends").alias("n"))


def lexical_scores(question: list[str], words: list[str]) -> tuple[list[float], list[float]]:
    """A deterministic stand-in for a model: words near words of the question score high."""
    asked = {w.lower().strip(".,;:!?") for w in question}
    hit = [1.0 if w.lower().strip(".,;:!?") in asked else 0.0 for w in words]
    start = [(hit[i - 1] if i else 0.0) - 2 * hit[i] for i in range(len(hit))]
    end = [(hit[i + 1] if i + 1 < len(hit) else 0.5) - 2 * hit[i] for i in range(len(hit))]
    return start, end


def lexical_scorer(questions, words):
    scored = [lexical_scores(q, w) for q, w in zip(questions, words)]
    return [s for s, _ in scored], [e for _, e in scored]


def _nbest(spark, sf):
    return ops.nbest_spans(fx.logits(spark, sf), "id", n_best=20, max_answer_length=30)


def nbest_spans(spark, sf):
    return _nbest(spark, sf).select("id", "rank", "start", "end", F.round("score", 6).alias("score"),
                                    F.round("probability", 6).alias("probability"))


def trim_null_answer(spark, sf):
    logits = fx.logits(spark, sf)
    spans = ops.nbest_spans(logits, "id", n_best=20, max_answer_length=30, first=1)
    whole = ops.with_null_answer(spans, ops.null_scores(logits), n_best=20)
    trimmed = qa_ops.trim_null_answer(ops.answers_by_question(whole))
    return trimmed.select("id", F.array_join("answer", "|").alias("answer"),
                          F.size("probability").alias("probabilities"))


def attach_results(spark, sf):
    """Scored vectors as results, their labels as features, nations as examples."""
    results = fx.logits(spark, sf).select(F.col("id").alias("feature_id"), F.round(
        F.array_max("start_logits"), 6).alias("best"))
    features = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("feature_id"), F.col("label").alias("example_id"))
    examples = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("example_id"), "n_name")
    return ops.attach_results(results, features, examples).select("feature_id", "example_id", "n_name", "best")


def score_answers(spark, sf):
    rows = fx.qa(spark, sf).select(F.col("uit_id").alias("id"), "question", "context")
    best = ops.answer_questions(rows, lexical_scorer, n_best=3, max_seq_length=64, doc_stride=16,
                                max_query_length=16)
    return best.withColumns({c: F.round(c, 6) for c in ("score", "probability")})


QUERIES = {
    "model_inputs": model_inputs,
    "chunk_contexts": chunk_contexts, "chunk_answer_spans": chunk_answer_spans, "nbest_spans": nbest_spans,
    "trim_null_answer": trim_null_answer, "attach_results": attach_results, "score_answers": score_answers,
}

_CHUNKS = """
select *, unnest(range(0, cast(case when n = 0 then 0 when n <= {length} then 1
    else ceil((n - {length}) / {stride}.0) + 1 end as bigint))) as chunk
from (select *, len(w) as n from ({source}))"""
_ZIPPED = """
select uit_id, context, unnest(pairs) as a from (
  select *, case when len(answers.answer_start) = 2 then list_filter(
      [{'t': a1, 's': answers.answer_start[1]}, {'t': a2, 's': answers.answer_start[2]}], lambda a: a.t <> '')
    else [] end as pairs from f_qa)"""
_SPANS = f"""
select uit_id, row_number() over (partition by uit_id order by ord_) - 1 as i, {fx.words_sql('context')} as w,
  len({fx.words_sql('substr(context, 1, a.s + 1)')}) - 1 as first,
  len({fx.words_sql('substr(context, 1, a.s + length(a.t))')}) - 1 as last
from (select *, row_number() over () as ord_ from zipped)"""
_STARTS = """
select id, v, i, row_number() over (partition by id order by v desc, i) as r
from (select id, unnest({0}) as v, unnest(range(0, len({0}))) as i from f_logits)"""
_RANKED = """
select *, exp(score - max(score) over (partition by id)) as wt from (
  select s.id, s.i as start, e.i as "end", s.v + e.v as score,
    row_number() over (partition by s.id order by s.v + e.v desc, s.i, e.i) as rank
  from starts s join ends e on s.id = e.id and s.r <= 20 and e.r <= 20 and e.i >= s.i and e.i - s.i + 1 <= 30)
where rank <= 20"""
# Slot 0 is the null answer: it takes part in the choice of starts and ends, and is no span.
_SLOTTED = """
select id, start, "end", score from (
  select s.id, s.i as start, e.i as "end", s.v + e.v as score,
    row_number() over (partition by s.id order by s.v + e.v desc, s.i, e.i) as r
  from starts s join ends e on s.id = e.id and s.r <= 20 and e.r <= 20 and s.i >= 1 and e.i >= s.i
    and e.i - s.i + 1 <= 30)
where r <= 20"""
_ENTRIES = """
select id, text, missing, least(r, 21) as rank from (
  select *, row_number() over (partition by id order by score desc, missing, start, "end") as r from (
    select id, start || '-' || "end" as text, score, false as missing, start, "end" from spans
    union all select id, '', start_logits[1] + end_logits[1], true, null, null from f_logits))
where missing or r <= 20"""
_NBEST = {"starts": _STARTS.format("start_logits"), "ends": _STARTS.format("end_logits"), "ranked": _RANKED}



def answers_sql(asked: str, n: int) -> dict[str, str]:
    """The stand-in scorer and the ranking over ``asked(id, question, context)``.

    Chunks of 61 words less the question, stride 16, the question cut to 16
    words; the ``n`` best starts and ends of a chunk, spans of at most 30 words.
    """
    plain = "trim(lower({0}), '.,;:!?')"
    best = "row_number() over (partition by id, c order by {0} desc, i)"
    return {
        "asked": asked,
        "sized": f"select id, list_transform(qw[1:16], lambda q: {plain.format('q')}) as qs, cw, len(cw) as n, "
                 f"61 - least(len(qw), 16) as room from (select id, {fx.words_sql('question')} as qw, "
                 f"{fx.words_sql('context')} as cw from asked)",
        "parts": "select id, qs, c, list_slice(cw, c * 16 + 1, c * 16 + room) as w from (select *, unnest(range(0, "
                 "cast(case when n = 0 then 0 when n <= room then 1 else ceil((n - room) / 16.0) + 1 end as bigint))) "
                 "as c from sized)",
        "hits": f"select id, c, i, case when list_contains(qs, {plain.format('word')}) then 1.0::double else 0 end as hit "
                "from (select id, qs, c, unnest(w) as word, unnest(range(0, len(w))) as i from parts)",
        "marks": "select id, c, i, coalesce(lag(hit) over p, 0) - 2 * hit as s, coalesce(lead(hit) over p, 0.5) - 2 * hit "
                 "as e from hits window p as (partition by id, c order by i)",
        "tops": f"select *, {best.format('s')} as rs, {best.format('e')} as re from marks",
        "pairs_": "select *, row_number() over (partition by id, c order by score desc, i, j) as r from ("
                  "select a.id, a.c, a.i, b.i as j, a.s + b.e as score from tops a join tops b on a.id = b.id "
                  f"and a.c = b.c and a.rs <= {n} and b.re <= {n} and b.i >= a.i and b.i - a.i + 1 <= 30)",
        "placed_": "select p.id, score, c.c * 16 + i as start, c.c * 16 + j as \"end\", c.c, "
                   "array_to_string(list_slice(w, i + 1, j + 1), ' ') as text "
                   f"from pairs_ p join parts c on p.id = c.id and p.c = c.c where r <= {n}",
        "answers_": "select *, exp(score - max(score) over (partition by id)) as wt from (select *, row_number() over "
                    f"(partition by id order by score desc, start, \"end\", c) as rank from placed_) where rank <= {n}",
    }


def _piece_ids_sql(text: str) -> str:
    pieces = (f"flatten(list_transform({fx.words_sql(text)}, lambda w: list_transform(range(0, (len(w) + 3) // 4), "
              "lambda i: substr(w, (i * 4 + 1)::int, 4))))")
    return f"list_transform({pieces}, lambda p: ('0x' || substr(md5(p), 1, 6))::bigint % {IDS} + {FIRST_ID})"


_FEATURES = {
    "coded": f"select uit_id, a1, list_slice({_piece_ids_sql('question')}, 1, 24) as q, {_piece_ids_sql('context')} as c, "
             f"len({_piece_ids_sql('a1')}) as a from f_qa",
    "sized": "select *, 93 - len(q) as room from coded where len(c) > 0",
    "cuts": "select *, unnest(range(0, 1 + ceil(greatest(len(c) - room, 0) / 32.0)::bigint)) as chunk from sized",
    "cut": "select *, list_slice(c, chunk * 32 + 1, chunk * 32 + room) as w from cuts",
    "filled": "select *, 93 - len(q) - len(w) as fill from cut",
}


def _joined(*parts: str) -> str:
    whole = parts[0]
    for part in parts[1:]:
        whole = f"list_concat({whole}, {part})"
    return f"md5(array_to_string({whole}, ','))"


def _many(value: int, size: str) -> str:
    return f"list_transform(range(0, {size}), lambda v: {value}::bigint)"


ORACLE = {
    "model_inputs": fx.sql(f"""
select uit_id, chunk::int as chunk, {_joined("[1::bigint]", "q", "[2::bigint]", "w", "[2::bigint]", _many(0, "fill"))} as input_ids,
  {_joined(_many(1, "len(q) + len(w) + 3"), _many(0, "fill"))} as attention_mask,
  {_joined(_many(0, "len(q) + 2"), _many(1, "len(w) + 1"), _many(0, "fill"))} as token_type_ids,
  {_joined(_many(0, "1"), _many(1, "len(q) + 1"), _many(0, "len(w)"), _many(1, "fill + 1"))} as p_mask,
  0::int as cls_index, a1 = '' as is_impossible,
  case when a1 <> '' and chunk = 0 and a <= len(w) then len(q) + 2 else 0 end::int as start_position,
  case when a1 <> '' and chunk = 0 and a <= len(w) then len(q) + 1 + a else 0 end::int as end_position,
  len(w)::int as n from filled""", "f_qa", **_FEATURES),
    "score_answers": fx.sql("""
select id, rank, round(score, 6) as score, start, "end", text,
  round(wt / sum(wt) over (partition by id), 6) as probability from answers_""", "f_qa",
                            **answers_sql("select uit_id as id, question, context from f_qa", 3)),
    "chunk_contexts": fx.sql("""
select doc_id, chunk, chunk * 128 as start, len(list_slice(w, chunk * 128 + 1, chunk * 128 + 384)) as n,
  md5(array_to_string(list_slice(w, chunk * 128 + 1, chunk * 128 + 384), ' ')) as digest from chunks""",
                             "f_contexts", chunks=_CHUNKS.format(
                                 length=384, stride=128,
                                 source=f"select doc_id, {fx.words_sql('context')} as w from f_contexts")),
    "chunk_answer_spans": fx.sql("""
select uit_id, i, chunk, chunk * 16 as start, case when inside then first - chunk * 16 end as start_position,
  case when inside then last - chunk * 16 end as end_position
from (select *, first >= chunk * 16 and last < least(chunk * 16 + 32, n) as inside from chunks)""",
                                 "f_qa", zipped=_ZIPPED, spans=_SPANS,
                                 chunks=_CHUNKS.format(length=32, stride=16, source="select * from spans")),
    "nbest_spans": fx.sql("""
select id, rank, start, "end", round(score, 6) as score,
  round(wt / sum(wt) over (partition by id), 6) as probability from ranked""", "f_logits", **_NBEST),
    "trim_null_answer": fx.sql("""
select r.id, coalesce(string_agg(r.text, '|' order by r.rank) filter (r.rank < m.last), '') as answer,
  count(*) - 1 as probabilities
from entries r join (select id, max(rank) as last from entries group by id) m on r.id = m.id group by r.id""",
                               "f_logits", starts=_NBEST["starts"], ends=_NBEST["ends"],
                               spans=_SLOTTED, entries=_ENTRIES),
    "attach_results": fx.sql("""
select id as feature_id, label as example_id, n_name, round(list_max(start_logits), 6) as best
from f_logits join embeddings on id = vec_id join nation on label = n_nationkey""", "f_logits"),
}
