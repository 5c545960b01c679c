"""The dictionary of distinct contexts and lookups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.functions.text import content_id, is_blank, py_strip
from echoloom.operators.spread import lookup_join, pick_rows


def nonblank(df: DataFrame, column: str = "context") -> DataFrame:
    """Rows with text, stripped."""
    return df.withColumn(column, py_strip(column)).where(F.length(column) > 0)


def distinct_contexts(df: DataFrame, order: str) -> DataFrame:
    """``context_id, context, first_seen``, one row per distinct stripped text.

    Grouping on the text itself keeps this a hash aggregate with map-side
    combine, so copies collapse before the shuffle; ids are computed after it.
    ``first_seen`` is the smallest ``order`` and gives the first-seen order.
    """
    return (
        nonblank(df.select("context", order))
        .groupBy("context").agg(F.min(order).alias("first_seen"))
        .select(content_id("context").alias("context_id"), "context", "first_seen")
    )


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key in ``order``, which tells the rows of a key apart."""
    return pick_rows(df, key, order, last=False)


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A dictionary: the last non-null ``key``/``value`` pair per key in ``order``, which tells the rows of a key apart."""
    known = df.where(F.col(key).isNotNull())
    return pick_rows(known, key, order, among=F.col(value).isNotNull()).select(key, value)


def distinct_ids(df: DataFrame, column: str = "context_id") -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def id_collisions(dictionary: DataFrame) -> DataFrame:
    """Ids shared by several texts, which a lookup by id would confuse."""
    return dictionary.groupBy("context_id").agg(F.count("*").alias("contexts")).where(F.col("contexts") > 1)


def replace_contexts(df: DataFrame, dictionary: DataFrame, hot_rows: int | None = None,
                     order: str | None = None) -> DataFrame:
    """Replace known text by its id; unknown or blank text passes unchanged.

    The join carries a 256-bit digest, so the dictionary's text is not shuffled;
    finding hot texts beforehand would read all text twice, so their split is
    left to adaptive execution unless ``hot_rows`` is given. ``known`` is true for a hit, false for a miss, null for blank text.
    Of several ids for one text the last wins, by ``order`` or in the order of the scan.
    """
    pairs = dictionary.select(F.sha2("context", 256).alias("_digest"), F.col("context_id").alias("_known_id"),
                              *([] if order is None else [F.col(order).alias("_place")]))
    if order is None:
        # An id of the scan holds within one pass, so the pair travels with it.
        placed = pairs.dropna().withColumn("_place", F.monotonically_increasing_id())
        digests = placed.groupBy("_digest").agg(F.max_by("_known_id", "_place").alias("_known_id"))
    else:
        digests = last_wins(pairs, "_digest", "_known_id", "_place")
    marked = df.withColumn("_digest", F.when(~is_blank("context"), F.sha2(py_strip("context"), 256)))
    joined = lookup_join(marked, digests, "_digest", hot_rows=hot_rows)
    hit = F.col("_known_id").isNotNull()
    plain = [c for c in df.columns if c not in ("context", "context_id")]
    earlier = F.col("context_id") if "context_id" in df.columns else F.lit(None).cast("string")
    return joined.select(
        *plain,
        F.when(~hit, F.col("context")).alias("context"),
        F.coalesce("_known_id", earlier).alias("context_id"),
        F.when(F.col("_digest").isNotNull(), hit).alias("known"),
    )


def replace_stats(replaced: DataFrame) -> DataFrame:
    return replaced.agg(F.count_if("known").alias("replaced"),
                        F.count_if(~F.col("known")).alias("missed"),
                        F.count_if(F.col("known").isNull()).alias("blank"))


def contexts_to_process(requested: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Requested ids with known text. ``dictionary`` has unique ids (``last_wins``)."""
    return distinct_ids(requested).join(dictionary.select("context_id", "context"), "context_id")


def unresolved_ids(requested: DataFrame, dictionary: DataFrame) -> DataFrame:
    return distinct_ids(requested).join(dictionary.select("context_id"), "context_id", "left_anti")


def filter_by_ids(df: DataFrame, ids: DataFrame | None, column: str = "context_id") -> DataFrame:
    """Rows whose id is in ``ids``; no ids, or an empty table, means no filter.

    The empty case is a subquery that stops at the first id, and the rows are
    read once for both cases.
    """
    if ids is None:
        return df
    given = ids.select(F.col(ids.columns[0]).alias(column)).where(F.col(column).isNotNull())
    none = given.limit(1).select(F.count("*")).scalar() == 0
    marked = lookup_join(df, given.distinct().withColumn("_wanted", F.lit(True)), column)
    return marked.where(F.col("_wanted") | none).select(*df.columns)


def limit_contexts(df: DataFrame, n: int | None, order: str = "context_id") -> DataFrame:
    """First ``n`` rows by ``order``; none or zero means all."""
    return df.orderBy(order).limit(n) if n and n > 0 else df
