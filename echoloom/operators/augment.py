"""Shuffling, splitting and labelling audio files for noise augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.signal import snr_mix
from echoloom.functions.text import hash_order, hash_pick, hash_unit
from echoloom.operators.speech import assign
from echoloom.operators.spread import hash_cut, hash_rank

# The transforms a file of the second branch may get.
TRANSFORMS = ("ColouredNoise", "BandPassFilter", "BandStopFilter", "Gain", "LowPassFilter", "Normalization")
# Only offered for one sample rate.
PITCH_TRANSFORM, PITCH_SAMPLE_RATE = "PitchShift", 16000
# Default share of the noise branch, level and weight range.
NOISE_RATIO, SNR_DB, MIN_WEIGHT, MAX_WEIGHT = 0.33, 10.0, 0.1, 1.5


def shuffled(df: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """Rows in a repeatable random order: a range-partitioned sort on a hash."""
    return df.orderBy(hash_order(seed, key), key)


def with_shuffle_position(df: DataFrame, key: str, seed: int | str = 0, name: str = "position") -> DataFrame:
    return hash_rank(df, [key], seed, name)


def ratio_split(df: DataFrame, key: str, ratio: float = NOISE_RATIO, seed: int | str = 0,
                first: str = "noise", second: str = "transform") -> DataFrame:
    """Add ``method``: exactly ``int(n * ratio)`` rows get ``first``."""
    cut = hash_cut(df, [key], seed, ratio, "_cut")
    return cut.withColumn("method", F.when(F.col("_cut"), first).otherwise(second)).drop("_cut")


def noise_weight(key: str, seed: int | str = 0) -> Column:
    """Repeatable uniform weight in the default range."""
    return F.lit(MIN_WEIGHT) + F.lit(MAX_WEIGHT - MIN_WEIGHT) * hash_unit(f"{seed}-weight", key)


def transform_name(key: str, seed: int | str = 0, sample_rate: int = PITCH_SAMPLE_RATE) -> Column:
    names = [*TRANSFORMS, *([PITCH_TRANSFORM] if sample_rate == PITCH_SAMPLE_RATE else [])]
    choice = hash_pick(F.lit(len(names)), f"{seed}-transform", key).cast("int")
    return F.get(F.array(*[F.lit(n) for n in names]), choice)


def assign_noise(df: DataFrame, clips: DataFrame, key: str, seed: int | str = 0) -> DataFrame:
    """A noise clip (``idx``-numbered catalogue) and a weight for each file."""
    return assign(df, clips, key, f"{seed}-clip").withColumn("weight", noise_weight(key, seed))


def augment_plan(files: DataFrame, clips: DataFrame, key: str, ratio: float = NOISE_RATIO,
                 seed: int | str = 0, sample_rate: int = PITCH_SAMPLE_RATE) -> DataFrame:
    """One table for both branches: ``method``, and its clip and weight or its transform.

    ``clips`` has ``idx`` and ``clip``; any ``idx`` will do, and an empty catalogue
    fails the job if a file needs a clip. Files of the other branch get no clip,
    without a second scan or a union.
    """
    noisy = F.col("method") == "noise"
    split = ratio_split(files, key, ratio, seed)
    return (
        assign(split, clips.select("idx", "clip"), key, f"{seed}-clip", among=noisy)
        .withColumn("weight", F.when(noisy, noise_weight(key, seed)))
        .withColumn("transform", F.when(~noisy, transform_name(key, seed, sample_rate)))
    )


def mix(signals: DataFrame, snr_db: float = SNR_DB) -> DataFrame:
    """Add noise ``n`` to signal ``x`` at a ratio, with the row's ``weight``."""
    return signals.withColumn("mixed", snr_mix("x", "n", snr_db, "weight"))


def augment_log(plan: DataFrame, key: str, seed: int | str = 0, per_line: int = 1000) -> DataFrame:
    """``method, part, files``: the file list of each branch in shuffle order.

    A list goes on in numbered parts of about ``per_line`` names, so neither
    branch is collected into one row.
    """
    ranked = hash_rank(plan.select("method", key), [key], seed, "_rank")
    part = F.floor((F.col("_rank") - 1) / F.lit(per_line))
    listed = F.sort_array(F.collect_list(F.struct("_rank", key)))
    return ranked.groupBy("method", part.alias("part")).agg(
        F.transform(listed, lambda x: x[key]).alias("files"))
