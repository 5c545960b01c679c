"""Audio file listings and WAV headers."""

from __future__ import annotations

import io
import re
import wave

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoloom.functions.text import dirname, has_suffix

LISTING = "path string, modificationTime timestamp, length bigint"
LOCAL_SCHEME = "^file:/+"
# Fixed value: bytes of a WAV header whose data chunk comes first.
PLAIN_HEADER = 44


def list_media(spark: SparkSession, folder: str, suffix: str | None = None, recursive: bool = True,
               ignore_case: bool = True) -> DataFrame:
    """``path, modificationTime, length`` of the files below a folder.

    The content column is never selected, so no file is opened. A folder that
    does not exist gives no row. Paths are plain, without ``file:``.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LISTING)
    files = found.select(F.regexp_replace("path", LOCAL_SCHEME, "/").alias("path"), "modificationTime", "length")
    return select_media(files, re.sub(LOCAL_SCHEME, "/", folder), suffix, recursive, ignore_case)


def select_media(listing: DataFrame, folder: str, suffix: str | None = None, recursive: bool = True,
                 ignore_case: bool = True) -> DataFrame:
    """Files of a listing by suffix; directly in ``folder`` unless recursive."""
    wanted = has_suffix("path", suffix, ignore_case)
    if not recursive:
        wanted = wanted & (dirname("path") == folder.rstrip("/"))
    return listing.where(wanted)


def wav_seconds(content: bytes | None) -> float | None:
    """Frames / rate from a WAV header, None if it cannot be read."""
    try:
        with wave.open(io.BytesIO(content), "rb") as f:
            return f.getnframes() / float(f.getframerate())
    except (wave.Error, EOFError, ZeroDivisionError, TypeError):
        return None


def _little_endian(head: Column, at: int, size: int) -> Column:
    """The unsigned integer in ``size`` bytes from the 1-based byte ``at``."""
    digits = F.hex(F.substring(head, at, size))
    swapped = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.conv(swapped, 16, 10).cast("bigint")


def media_duration(files: DataFrame) -> DataFrame:
    """``path, duration_s`` from ``path, content``; null for other formats.

    The length of plain PCM comes from its 44 header bytes by expressions. Python
    sees only WAV files whose header has another form, and no other format.
    """
    content = F.col("content")
    marked = lambda at, mark: F.substring(content, at, len(mark)) == F.lit(mark)
    wav = marked(1, b"RIFF") & marked(9, b"WAVE")
    plain = (wav & marked(13, b"fmt \x10\0\0\0\x01\0") & marked(37, b"data")
             & (F.octet_length(content) >= PLAIN_HEADER))
    frame = _little_endian(content, 23, 2) * F.floor((_little_endian(content, 35, 2) + 7) / 8)
    frames = F.floor(F.try_divide(_little_endian(content, 41, 4), frame))

    @F.pandas_udf("double")
    def measure(contents: pd.Series) -> pd.Series:
        return pd.Series([wav_seconds(c) for c in contents], dtype="float64")

    other = measure(F.when(wav & ~plain, content))
    return files.select("path", other.alias("_other"), plain.alias("_plain"),
                        F.try_divide(frames, _little_endian(content, 25, 4)).alias("_header")).select(
        "path", F.when(F.col("_plain"), F.col("_header")).otherwise(F.col("_other")).alias("duration_s"))
