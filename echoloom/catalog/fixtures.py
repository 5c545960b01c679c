"""Inputs derived from the test tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.functions.text import PUNCTUATION, content_id
from echoloom.operators.spread import blocked_rank


# More than the turns of any conversation, so that conversation and turn make one integer.
TURNS = 4_294_967_296


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Records with contexts: ``doc_id, context, title, split``."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "validation")
    return table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("context"), F.col("source").alias("title"),
        split.otherwise("test").alias("split"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct contexts of the train split only, so that lookups miss."""
    train = contexts(spark, sf).where(F.col("split") == "train").select("context").distinct()
    return train.select(content_id("context").alias("context_id"), "context")


def qa(spark: SparkSession, sf: str) -> DataFrame:
    """Question records from user turns and the assistant turns right after them.

    Turns are numbered without gaps, so the next turn is an equi-join and no
    conversation has to be sorted in one task.
    """
    turns = table(spark, sf, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    pairs = asked.join(replies, ["conv_id", "turn"]).withColumns({
        "a1": F.split_part("context", F.lit("."), F.lit(1)),
        "a2": F.trim(F.split_part("context", F.lit("."), F.lit(2))),
    })
    name = F.concat(F.lit("q"), "conv_id", F.lit("_"), "turn")
    start = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.array(F.lit(0))).otherwise(
        F.array(F.lit(0), (F.instr("context", F.col("a2")) - 1).cast("int")))
    return pairs.select(
        F.when(F.col("conv_id") % 10 != 8, name).alias("id"), name.alias("uit_id"),
        F.when(F.col("conv_id") % 10 != 9, F.concat(F.lit("conv_"), F.col("conv_id") % 10)).alias("title"),
        "context", "question",
        F.struct(F.array("a1", "a2").alias("text"), start.alias("answer_start")).alias("answers"),
        "a1", "a2", "conv_id", "turn", (F.col("conv_id") * TURNS + F.col("turn")).alias("ord"))


def predictions(spark: SparkSession, sf: str, missing: str | None = None) -> DataFrame:
    """A quarter exact, a quarter re-cased, a quarter partial, a quarter missing or as given."""
    kind = F.col("conv_id") % 4
    answer = (F.when(kind == 0, F.col("a1")).when(kind == 1, F.concat(F.lower("a1"), F.lit("!")))
              .otherwise(F.split_part("a1", F.lit(" "), F.lit(1))))
    rows = qa(spark, sf)
    if missing is None:
        rows = rows.where(kind != 3)
    answer = F.when(kind == 3, missing).otherwise(answer)
    return rows.select(F.col("uit_id").alias("id"), answer.alias("prediction"), "ord")


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Recognition results: a tenth failed, a tenth empty, else one segment per line."""
    segment = lambda s: F.struct(F.array(
        F.struct(s.alias("transcript"), F.lit(0.9).alias("confidence")),
        F.struct(F.lower(s).alias("transcript"), F.lit(0.5).alias("confidence"))).alias("alternatives"))
    found = F.transform(F.split("text", "\n"), segment)
    kind = F.col("doc_id") % 10
    ident = content_id("text")
    return table(spark, sf, "documents").select(
        "doc_id", ident.alias("context_id"), F.concat(ident, F.lit(".wav")).alias("file_name"),
        F.when(kind == 1, F.filter(found, lambda s: F.lit(False))).when(kind != 0, found).alias("results"),
        F.when(kind == 0, "Audio exceeds duration limit").alias("error"),
        (F.col("n_chars") / 1000.0).alias("processing_time"))


def media(spark: SparkSession, sf: str) -> DataFrame:
    """A media listing; every seventh duration is unknown."""
    suffix = F.when(F.col("doc_id") % 3 == 0, ".WAV").when(F.col("doc_id") % 3 == 1, ".wav").otherwise(".mp3")
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("/audio/"), "lang", F.lit("/"), content_id("text"), suffix).alias("path"),
        (F.col("n_chars") * 2000).alias("size_bytes"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") / 15.0).alias("duration_s"))


def refs(spark: SparkSession, sf: str) -> DataFrame:
    """References to media: exact, in another case, by id, or to nothing."""
    kind = F.col("doc_id") % 5
    path = F.col("path")
    return media(spark, sf).select(
        "doc_id",
        F.when(kind == 0, path).when(kind == 1, F.lower(path)).when(kind == 4, F.concat(path, F.lit(".gone")))
        .alias("audio_path"),
        F.when(kind == 2, path).alias("file_path"), F.lit(None).cast("string").alias("audio_file"),
        F.when(kind == 3, F.regexp_extract(path, "(ctx_[0-9a-f]+)", 1)).alias("context_id"))


def voices(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("n_nationkey")
    kind = F.when(key % 3 == 0, "Neural2-").when(key % 3 == 1, "Wavenet-").otherwise("Standard-")
    return table(spark, sf, "nation").select(
        key.alias("idx"), F.concat(F.lit("vi-VN-"), kind, "n_name").alias("voice_name"),
        F.when(key % 2 == 0, "FEMALE").otherwise("MALE").alias("voice_gender"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of 64 samples with shorter or longer noise."""
    e = F.col("embedding")
    noise = F.when(F.col("vec_id") % 2 == 0, F.slice(e, 1, 32)).otherwise(F.concat(e, F.slice(e, 1, 16)))
    return table(spark, sf, "embeddings").select(
        "vec_id", e.cast("array<double>").alias("x"), noise.cast("array<double>").alias("n"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    scores = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), scores.alias("start_logits"), F.reverse(scores).alias("end_logits"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A metric log: the steps of a run are its events in time order."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "ts", "event_id",
                                               F.col("value").alias("m"))
    ranked = blocked_rank(events, ["run_id"], ["ts", "event_id"], "step", F.date_trunc("hour", "ts"))
    return ranked.select("run_id", "step", "m", "event_id")


# The same fixtures in DuckDB, in an order in which each may use the earlier ones.
FIXTURE_SQL = {
    "f_contexts": """
select doc_id, text as context, source as title,
  case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'validation' else 'test' end as split
from documents""",
    "f_dict": """
select distinct concat('ctx_', substr(md5(context), 1, 8)) as context_id, context
from f_contexts where split = 'train'""",
    "f_qa": """
select case when conv_id % 10 = 8 then null else concat('q', conv_id, '_', turn) end as id,
  concat('q', conv_id, '_', turn) as uit_id,
  case when conv_id % 10 = 9 then null else concat('conv_', conv_id % 10) end as title,
  nx as context, text as question,
  {'text': [a1, a2], 'answer_start':
    case when (conv_id + turn) % 7 = 0 then [0] else [0, cast(instr(nx, a2) - 1 as int)] end} as answers,
  a1, a2, conv_id, turn, conv_id * 4294967296 + turn as ord
from (select *, split_part(nx, '.', 1) as a1, trim(split_part(nx, '.', 2)) as a2 from (
  select conv_id, turn, role, text, lead(text) over (partition by conv_id order by turn) as nx,
    lead(role) over (partition by conv_id order by turn) as nr from conversations) z
  where role = 'user' and nr = 'assistant') y""",
    "f_predictions": """
select uit_id as id, case conv_id % 4 when 0 then a1 when 1 then concat(lower(a1), '!')
  else split_part(a1, ' ', 1) end as prediction
from f_qa where conv_id % 4 <> 3""",
    "f_responses": """
select doc_id, concat('ctx_', substr(md5(text), 1, 8)) as context_id,
  concat('ctx_', substr(md5(text), 1, 8), '.wav') as file_name,
  case when doc_id % 10 = 0 then null when doc_id % 10 = 1 then list_filter(r, lambda s: false) else r end as results,
  case when doc_id % 10 = 0 then 'Audio exceeds duration limit' end as error, n_chars / 1000.0e0 as processing_time
from (select *, list_transform(string_split(text, chr(10)), lambda s: {'alternatives': [
    {'transcript': s, 'confidence': 0.9e0}, {'transcript': lower(s), 'confidence': 0.5e0}]}) as r from documents) d""",
    "f_media": """
select doc_id, concat('/audio/', lang, '/ctx_', substr(md5(text), 1, 8),
    case doc_id % 3 when 0 then '.WAV' when 1 then '.wav' else '.mp3' end) as path,
  n_chars * 2000 as size_bytes, case when doc_id % 7 = 0 then null else n_chars / 15.0e0 end as duration_s
from documents""",
    "f_refs": """
select doc_id,
  case when doc_id % 5 = 0 then path when doc_id % 5 = 1 then lower(path)
    when doc_id % 5 = 4 then concat(path, '.gone') end as audio_path,
  case when doc_id % 5 = 2 then path end as file_path, cast(null as varchar) as audio_file,
  case when doc_id % 5 = 3 then regexp_extract(path, '(ctx_[0-9a-f]+)', 1) end as context_id
from f_media""",
    "f_voices": """
select n_nationkey as idx,
  concat('vi-VN-', case n_nationkey % 3 when 0 then 'Neural2-' when 1 then 'Wavenet-' else 'Standard-' end, n_name)
    as voice_name,
  case when n_nationkey % 2 = 0 then 'FEMALE' else 'MALE' end as voice_gender
from nation""",
    "f_signals": """
select vec_id, cast(embedding as double[]) as x,
  cast(case when vec_id % 2 = 0 then list_slice(embedding, 1, 32)
    else list_concat(embedding, list_slice(embedding, 1, 16)) end as double[]) as n
from embeddings""",
    "f_logits": """
select vec_id as id, cast(embedding as double[]) as start_logits,
  list_reverse(cast(embedding as double[])) as end_logits
from embeddings""",
    "f_runs": """
select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) as step, value as m, event_id
from events""",
}

_NEEDS = {"f_dict": ["f_contexts"], "f_predictions": ["f_qa"], "f_refs": ["f_media"]}

# The blanks of Python's str methods as an RE2 character class.
BLANK = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]"


def sql(body: str, *fixtures: str, recursive: bool = False, **ctes: str) -> str:
    """``body`` with the fixtures, and further named queries, in its WITH clause."""
    wanted: list[str] = []
    for name in fixtures:
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    parts = [f"{n} as ({FIXTURE_SQL[n]})" for n in FIXTURE_SQL if n in wanted]
    parts += [f"{n} as ({q})" for n, q in ctes.items()]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{BLANK}+'), lambda w: w <> '')"


def answer_words_sql(x: str) -> str:
    marks = PUNCTUATION.replace("'", "''")
    return words_sql(f"translate(lower({x}), '{marks}', '')")


def normal_sql(x: str) -> str:
    return f"array_to_string({answer_words_sql(x)}, ' ')"


def simple_normal_sql(x: str) -> str:
    return f"array_to_string({words_sql(f'lower({x})')}, ' ')"


def id_sql(x: str) -> str:
    return f"concat('ctx_', substr(md5({x}), 1, 8))"


def hash_sql(key: str, seed: object) -> str:
    return f"md5(concat({key}, ':{seed}'))"


def pick_sql(key: str, seed: object, n: str) -> str:
    return f"(('0x' || substr({hash_sql(key, seed)}, 1, 8))::bigint % {n})"


def unit_sql(key: str, seed: object) -> str:
    return f"(('0x' || substr({hash_sql(key, seed)}, 1, 8))::bigint / 4294967296.0::double)"
