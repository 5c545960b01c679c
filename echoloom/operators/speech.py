"""Synthesis and recognition bookkeeping around the (external) speech services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import ColumnLike, basename, col, dirname, hash_pick, join_path, stem
from echoloom.operators.spread import blocked_rank, by_width, lookup_join

# Limits of an inline recognition request.
MAX_INLINE_BYTES = 10 * 1024 * 1024
MAX_INLINE_SECONDS = 60
# Fixed value: the recogniser's message that asks for a staged retry.
DURATION_MESSAGE = "audio exceeds duration limit"
# Name parts of neural voices, case-sensitive.
NEURAL_MARKS = ("Neural", "Wavenet", "HD")


def id_from_path(path: ColumnLike) -> Column:
    return stem(path)


def staged(size: ColumnLike, duration: ColumnLike, force: bool = False) -> Column:
    """Stage a file that is too large or too long; unknown length does not count."""
    long = F.coalesce(col(duration) > MAX_INLINE_SECONDS, F.lit(False))
    return F.lit(force) | (col(size) > MAX_INLINE_BYTES) | long


def staging_reason(size: ColumnLike, duration: ColumnLike, force: bool = False) -> Column:
    megabytes = col(size) / F.lit(1024 * 1024)
    return (
        F.when(F.lit(force), "forced")
        .when(col(size) > MAX_INLINE_BYTES, F.format_string("file size %.2fMB > 10MB", F.bround(megabytes, 2)))
        .when(col(duration) > MAX_INLINE_SECONDS,
              F.format_string("duration %.2fs > 60s", F.bround(col(duration), 2)))
        .otherwise("as a precaution")
    )


def retry_staged(is_staged: ColumnLike, error: ColumnLike) -> Column:
    """True if an inline request failed only for its length."""
    return ~col(is_staged) & F.coalesce(F.contains(F.lower(col(error)), F.lit(DURATION_MESSAGE)), F.lit(False))


def flatten_hypotheses(df: DataFrame) -> DataFrame:
    """Recognition segments to ``transcription, all_alternatives, empty_result``.

    The text joins the first alternative of each segment; segments without one
    are left out; a missing confidence becomes 0. Error rows get no text.
    """
    found = F.transform(F.coalesce("results", F.array().cast(df.schema["results"].dataType)),
                        lambda r: r["alternatives"])
    failed = F.col("error").isNotNull()
    segments = df.withColumn("_segments", F.when(~failed, F.filter(found, lambda a: F.size(a) > 0)))
    kept = F.transform("_segments", lambda a: F.transform(a, lambda x: x.withField(
        "confidence", F.coalesce(x["confidence"], F.lit(0.0)))))
    text = F.array_join(F.transform("_segments", lambda a: F.get(a, F.lit(0))["transcript"]), " ")
    return segments.select(
        *df.columns, text.alias("transcription"), kept.alias("all_alternatives"),
        F.coalesce(F.size("_segments") == 0, F.lit(True)).alias("empty_result"))


def transcript_lines(df: DataFrame, keep: tuple[str, ...] = ("file_name", "processing_time")) -> DataFrame:
    """``context_id, context, empty_result, error`` and ``status``, one line per result.

    Written without null fields this gives the three line shapes: text, empty
    text with a mark, or an error.
    """
    good = F.col("transcription").isNotNull() & F.col("error").isNull()
    empty = good & F.coalesce("empty_result", F.lit(False))
    status = F.when(empty, "empty").when(good, "success").otherwise("failed")
    return df.select(
        "context_id",
        F.when(empty, "").when(good, F.col("transcription")).alias("context"),
        F.when(empty, F.lit(True)).alias("empty_result"),
        F.when(~good, F.coalesce("error", F.lit("Unknown error"))).alias("error"),
        status.alias("status"), *keep,
    )


def batch_summary(lines: DataFrame) -> DataFrame:
    """Counts by status and the sum and mean of the per-file times."""
    return lines.agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "empty").alias("empty_count"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("total_time"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("avg_time_per_file"),
    )


def voice_type(name: ColumnLike) -> Column:
    neural = F.lit(False)
    for mark in NEURAL_MARKS:
        neural = neural | F.contains(col(name), F.lit(mark))
    return F.when(neural, "NEURAL").otherwise("STANDARD")


def assign(df: DataFrame, catalogue: DataFrame, key: str, seed: int | str, index: str = "idx",
           among: Column | None = None) -> DataFrame:
    """Give each row (of ``among``) one catalogue entry, chosen by a hash of ``key`` and ``seed``.

    Entries are numbered 0..n-1 in the order of ``index``, whatever its values; n
    is a subquery, and an empty catalogue fails the job. The join is an equi-join on
    the number: Spark broadcasts a catalogue below its size threshold and
    otherwise shuffles on the evenly spread number.
    """
    n = catalogue.select(F.count("*")).scalar()
    entries = blocked_rank(catalogue, [], [index], "_slot", by_width(index, 100_000)).withColumn(
        "_slot", F.col("_slot") - 1).drop(index)
    fits = (n > 0) if among is None else (n > 0) | ~F.coalesce(among, F.lit(False))
    # A filter, since a join with an empty table needs no slot and would not fail.
    filled = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.lit("the catalogue is empty")).cast("boolean"))
    slot = hash_pick(F.greatest(n, F.lit(1)), seed, key).cast("bigint")
    if among is None:
        return df.where(filled).withColumn("_slot", slot).join(entries, "_slot", "left").drop("_slot")
    # Rows without an entry have no slot: they are spread, not gathered.
    return lookup_join(df.where(filled).withColumn("_slot", F.when(among, slot)), entries, "_slot").drop("_slot")


def synthesis_metadata(contexts: DataFrame, voices: DataFrame, seed: int | str = 0,
                       when: Column | None = None) -> DataFrame:
    """One row per context to synthesise: file name, voice, text length in characters.

    ``contexts`` may carry a boolean ``success``; failed rows are left out.
    """
    done = contexts.where("success") if "success" in contexts.columns else contexts
    return assign(done, voices, "context_id", seed).select(
        "context_id",
        F.concat("context_id", F.lit(".mp3")).alias("audio_file"),
        "voice_name", "voice_gender", voice_type("voice_name").alias("voice_type"),
        (F.unix_micros(F.current_timestamp()) / 1e6 if when is None else when).alias("timestamp"),
        F.length("context").alias("context_length"),
    )


def resolve_media(refs: DataFrame, listing: DataFrame, base_dir: str) -> DataFrame:
    """Add ``wanted``, the path a reference names, and ``media_path``, the file found.

    Named paths (first non-empty of audio_path, file_path, path, then
    audio_file) match exactly or, failing that, by name without case in the same
    folder, smallest name first. References with only a context_id try
    ``.wav``, then ``.mp3``. Both tries are lookups in one index of the listing.
    """
    def given(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in refs.columns else F.lit(None).cast("string")

    base = F.lit(base_dir)
    named = F.coalesce(given("audio_path"), given("file_path"), given("path"), given("audio_file"))
    wanted = F.when(named.isNotNull(), join_path(base, named))
    by_id = given("context_id")

    def folded(p: Column) -> Column:
        return F.concat(F.lit("~"), dirname(p), F.lit("/"), F.lower(basename(p)))

    def exact(p: Column) -> Column:
        return F.concat(F.lit("="), p)

    files = listing.select("path").distinct()
    index = files.select(exact(F.col("path")).alias("key"), F.col("path").alias("file")).unionByName(
        files.groupBy(folded(F.col("path")).alias("key")).agg(F.min("path").alias("file")))
    asked = refs.withColumn("wanted", wanted).withColumns({
        "_first": F.coalesce(exact(F.col("wanted")), exact(join_path(base, F.concat(by_id, F.lit(".wav"))))),
        "_second": F.coalesce(folded(F.col("wanted")), exact(join_path(base, F.concat(by_id, F.lit(".mp3"))))),
    })
    found = lookup_join(asked, index.toDF("_first", "_file1"), "_first")
    # Only rows still without a file take part in the second lookup.
    found = found.withColumn("_second", F.when(F.col("_file1").isNull(), F.col("_second")))
    found = lookup_join(found, index.toDF("_second", "_file2"), "_second")
    return found.select(*refs.columns, "wanted", F.coalesce("_file1", "_file2").alias("media_path"))


def resolved_media(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("media_path").isNotNull())


def missing_media(resolved: DataFrame) -> DataFrame:
    """Named files that do not exist; id-only references are never reported."""
    return resolved.where(F.col("media_path").isNull() & F.col("wanted").isNotNull())
