"""Signals and the noise augmentation plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom.catalog import fixtures as fx
from echoloom.functions import signal
from echoloom.operators import augment as ops
from echoloom.operators.spread import index_from_zero
from echoloom.session import materialize

SEED = 11


def _samples(df, samples: Column):
    """One row per sample; adding 0 removes the sign of a zero."""
    return df.select("vec_id", F.posexplode(samples).alias("i", "v")).select(
        "vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def signal_rms(spark, sf):
    return fx.signals(spark, sf).select("vec_id", F.round(signal.rms("x"), 9).alias("x"),
                                        F.round(signal.rms("n"), 9).alias("n"))


def match_length(spark, sf):
    return _samples(fx.signals(spark, sf), signal.match_length("x", "n"))


def snr_mix(spark, sf):
    weighted = fx.signals(spark, sf).withColumn("weight", ops.noise_weight("vec_id", SEED))
    return _samples(ops.mix(weighted), F.col("mixed"))


def signal_gain(spark, sf):
    rows = fx.signals(spark, sf).withColumn("db", (F.col("vec_id") % 17 - 8).cast("double"))
    return _samples(rows, signal.gain("x", "db"))


def peak_normalize(spark, sf):
    return _samples(fx.signals(spark, sf), signal.peak_normalize("x"))


def _files(spark, sf):
    return fx.table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id", F.lit(".mp3")).alias("file"))


def _clips(spark, sf):
    names = fx.table(spark, sf, "embeddings").select(F.concat(F.lit("noise"), "vec_id", F.lit(".wav")).alias("clip"))
    return materialize(index_from_zero(names, "clip"), "clips")


def _plan(spark, sf):
    return ops.augment_plan(_files(spark, sf), _clips(spark, sf), "file", seed=SEED)


def shuffled_export(spark, sf):
    return ops.shuffled(ops.with_shuffle_position(_files(spark, sf), "file", SEED), "file", SEED)


def ratio_split(spark, sf):
    return ops.ratio_split(_files(spark, sf), "file", seed=SEED)


def assign_noise(spark, sf):
    done = ops.assign_noise(_files(spark, sf), _clips(spark, sf), "file", SEED)
    return done.withColumn("weight", F.round("weight", 9))


def augment_plan(spark, sf):
    return _plan(spark, sf).withColumn("weight", F.round("weight", 9))


def augment_log(spark, sf):
    split = materialize(ops.ratio_split(_files(spark, sf), "file", seed=SEED), "split")
    log = ops.augment_log(split, "file", SEED, per_line=500)
    return log.select("method", "part", F.size("files").alias("n"), F.md5(F.array_join("files", "|")).alias("files"))


QUERIES = {
    "signal_rms": signal_rms, "match_length": match_length, "snr_mix": snr_mix, "signal_gain": signal_gain,
    "peak_normalize": peak_normalize, "shuffled_export": shuffled_export, "ratio_split": ratio_split,
    "assign_noise": assign_noise, "augment_plan": augment_plan, "augment_log": augment_log,
}

_RMS = "sqrt(list_sum(list_transform({0}, lambda v: v * v)) / len({0}))"
_MATCHED = """
select vec_id, x, case when len(n) >= len(x) then list_slice(n, 1, len(x))
  else list_concat(n, list_transform(range(0, len(x) - len(n)), lambda v: 0.0::double)) end as n from f_signals"""
_WEIGHT = "0.1::double + 1.4::double * " + fx.unit_sql("{0}", f"{SEED}-weight")
_FILES = "select concat('f', doc_id, '.mp3') as file from documents"
_CLIPS = """
select clip, row_number() over (order by md5(clip || ':'), clip) - 1 as idx
from (select concat('noise', vec_id, '.wav') as clip from embeddings)"""
_SHUFFLED = f"""
select file, row_number() over (order by {fx.hash_sql('file', SEED)}, file) as position, count(*) over () as n
from files"""
_METHODS = """
select *, case when position <= floor(n * 0.33::double) then 'noise' else 'transform' end as method from shuffled"""
_NAMES = "['" + "', '".join([*ops.TRANSFORMS, ops.PITCH_TRANSFORM]) + "']"
_PICK = fx.pick_sql("file", f"{SEED}-clip", "(select count(*) from clips)")
_PLAN = {"files": _FILES, "shuffled": _SHUFFLED, "methods": _METHODS}


def _samples_sql(x: str) -> str:
    return f"""
select vec_id, i, round(v, 6) + 0.0::double as v
from (select vec_id, unnest({x}) as v, unnest(range(0, len({x}))) as i from rows_)"""


ORACLE = {
    "signal_rms": fx.sql(f"""
select vec_id, round({_RMS.format('x')}, 9) as x, round({_RMS.format('n')}, 9) as n from f_signals""", "f_signals"),
    "match_length": fx.sql(_samples_sql("n"), "f_signals", rows_=_MATCHED),
    "snr_mix": fx.sql(_samples_sql("y"), "f_signals", matched=_MATCHED, scaled=f"""
select *, {_RMS.format('x')} / pow(10.0::double, 10.0::double / 20) / ({_RMS.format('n')} + 1e-9::double)
  * ({_WEIGHT.format('vec_id')}) as k from matched""",
                      rows_="select vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] + n[i] * k) as y "
                            "from scaled"),
    "signal_gain": fx.sql(_samples_sql("y"), "f_signals", rows_="""
select vec_id, list_transform(x, lambda v: v * pow(10.0::double, (vec_id % 17 - 8) / 20.0::double)) as y
from f_signals"""),
    "peak_normalize": fx.sql(_samples_sql("y"), "f_signals", rows_="""
select vec_id, list_transform(x, lambda v: case when peak > 0 then v / peak else v end) as y
from (select *, list_max(list_transform(x, lambda v: abs(v))) as peak from f_signals)"""),
    "shuffled_export": fx.sql("select file, position from shuffled", files=_FILES, shuffled=_SHUFFLED),
    "ratio_split": fx.sql("select file, method from methods", **_PLAN),
    "assign_noise": fx.sql(f"""
select file, clip, round({_WEIGHT.format('file')}, 9) as weight from files join clips on idx = {_PICK}""",
                           files=_FILES, clips=_CLIPS),
    "augment_plan": fx.sql(f"""
select file, method, clip, case when method = 'noise' then round({_WEIGHT.format('file')}, 9) end as weight,
  case when method <> 'noise' then {_NAMES}[{fx.pick_sql('file', f'{SEED}-transform', '7')} + 1] end as transform
from methods left join clips on method = 'noise' and idx = {_PICK}""", **_PLAN, clips=_CLIPS),
    "augment_log": fx.sql("""
select method, (position - 1) // 500 as part, count(*) as n, md5(string_agg(file, '|' order by position)) as files
from methods group by all""", **_PLAN),
}
