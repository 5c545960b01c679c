"""Sample-array arithmetic in double precision, one row per signal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, col, let


def rms(x: ColumnLike) -> Column:
    """sqrt(mean(x^2)); null for an empty signal."""
    v = col(x)
    return F.sqrt(F.try_divide(
        F.aggregate(v, F.lit(0.0), lambda s, a: s + a.cast("double") * a.cast("double")), F.size(v)))


def match_length(signal: ColumnLike, noise: ColumnLike) -> Column:
    """The noise cut, or padded with zeros, to the signal's length."""
    x, n = col(signal), col(noise)
    missing = F.greatest(F.size(x) - F.size(n), F.lit(0))
    return F.slice(F.concat(n, F.array_repeat(F.lit(0.0), missing)), F.lit(1), F.size(x))


def snr_mix(signal: ColumnLike, noise: ColumnLike, snr_db: ColumnLike | float = 10.0,
            weight: ColumnLike | float = 1.0) -> Column:
    """Add noise scaled to a signal-to-noise ratio; noise energy is taken after padding."""
    snr = F.lit(snr_db) if isinstance(snr_db, (int, float)) else col(snr_db)
    w = F.lit(weight) if isinstance(weight, (int, float)) else col(weight)
    x = col(signal)

    def mix(n: Column) -> Column:
        wanted = rms(x) / F.pow(F.lit(10.0), snr / 20)
        scale = wanted / (rms(n) + F.lit(1e-9)) * w
        return let(scale, lambda k: F.zip_with(x, n, lambda a, b: a + b * k))

    return let(match_length(x, noise), mix)


def gain(signal: ColumnLike, decibel: ColumnLike | float) -> Column:
    db = F.lit(float(decibel)) if isinstance(decibel, (int, float)) else col(decibel)
    return let(F.pow(F.lit(10.0), db / 20), lambda k: F.transform(col(signal), lambda v: v * k))


def peak_normalize(signal: ColumnLike) -> Column:
    """Scale so that the largest magnitude is 1; silence stays silent."""
    x = col(signal)
    return let(F.array_max(F.transform(x, lambda v: F.abs(v))), lambda peak: F.transform(
        x, lambda v: F.when(peak > 0, v / peak).otherwise(v)))
