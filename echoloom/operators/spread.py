"""Joins and running totals that hold when one key owns a large share of the rows."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoloom.functions.text import hash_order
from echoloom.session import materialize

# Digits of a hash that cut rows into shares at once, and the digits that are used at most; blocks of a coarser block.
DIGITS, HASH_DIGITS, SHARES = 3, 30, 4096
# Rows of a share that one task sorts.
SHARE_ROWS = 1 << 16
# Largest counted number of keys that is broadcast.
BROADCAST_KEYS = 100_000


# Settings without which a hot key of a join stays in one task.
SKEW_SETTINGS = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
                 "spark.sql.adaptive.forceOptimizeSkewedJoin")


def check_skew_settings(spark: SparkSession) -> None:
    """Warn where a session does not split the hot keys of joins; its settings are left alone."""
    off = [key for key in SKEW_SETTINGS if spark.conf.get(key) != "true"]
    if off:
        warnings.warn(f"hot keys stay in one task without {', '.join(off)}; set them, or pass hot_rows", stacklevel=3)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left",
                hot_rows: int | None = None) -> DataFrame:
    """Join rows to a table with unique ``key`` values, whatever the key's distribution.

    Rows with a null key cannot match; they are spread over the tasks instead of
    meeting in one. Of a hot key, adaptive execution splits the rows by the
    measured partition sizes. ``hot_rows`` splits them in the plan itself, for a
    key column that is cheap to read: keys with more rows are spread over
    ``count / hot_rows`` salts, and only their right rows are repeated.

    The salt is the number of the task that holds the row, so copies of one row
    separate too and a task retried after a lost executor draws the same salt.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type {how!r}")
    known = right.where(F.col(key).isNotNull())
    if hot_rows is None:
        check_skew_settings(left.sparkSession)
        if how == "inner":
            return left.join(known, key)
        probe = left.withColumn("_salt", F.when(F.col(key).isNull(), F.spark_partition_id()).otherwise(0))
        # Always 0, but no literal: the optimizer would drop a constant from the
        # join keys, and null keys would meet in one task again.
        zero = F.pmod(F.spark_partition_id(), F.lit(1))
        return probe.join(known.withColumn("_salt", zero), [key, "_salt"], how).drop("_salt")
    counts = (
        left.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows"))
        .where(F.col("_rows") > hot_rows).select("_hot", F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts"))
    )
    # Every hot key is split; the table of them is broadcast only if a count finds it small.
    hot = materialize(counts, "hot-keys")
    hot = bounded(hot, hot.count())
    probe = (
        left.withColumn("_task", F.spark_partition_id())
        .join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.when(F.col(key).isNull(), F.col("_task")).otherwise(
            F.pmod(F.col("_task"), F.coalesce("_salts", F.lit(1)))))
        .drop("_task", "_hot", "_salts")
    )
    build = (
        known.join(hot, F.col(key) == F.col("_hot"), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_hot", "_salts")
    )
    return probe.join(build, [key, "_salt"], how).drop("_salt")


def pick_rows(df: DataFrame, key: str, order: str, last: bool = True, among: Column | None = None) -> DataFrame:
    """The last (or first) row of each key, null being a key, by ``order``, a column that tells its rows apart.

    Only keys and numbers are grouped, in a hash aggregate whose map-side combine leaves one row per key and task; the
    rows themselves then meet their key's place. Rows of a large key spread over tasks, since the place is part of the
    join, and few winners are broadcast, so that texts do not move. ``among`` says which rows count. ``order`` must be
    a column of the source: it is read twice, and an id made on the way could differ the second time.
    """
    place = F.col(order) if among is None else F.when(among, F.col(order))
    best = df.groupBy(F.col(key).alias("_key")).agg((F.max if last else F.min)(place).alias("_place"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col(order) == F.col("_place"))
    return df.join(best, same, "left_semi")


def _with_block_totals(df: DataFrame, keys: Sequence[str], blocks: Sequence[Column], weight: Column) -> DataFrame:
    """Add ``_block``, the finest of nested blocks, and ``_before``, the weight of the key's earlier blocks.

    The sizes form one row per (key, block), which are summed in order within the next coarser block, whose sizes are
    summed within the one above: a task sees the blocks of one coarser block.
    """
    names = [*(f"_block{i}" for i in range(len(blocks) - 1)), "_block"]
    marked = df.withColumns(dict(zip(names, blocks)))
    held = {c: f"_g{i}" for i, c in enumerate([*keys, *names])}
    sizes = marked.groupBy(*[F.col(c).alias(n) for c, n in held.items()]).agg(F.sum(weight).alias("_weight"))
    totals = None
    for level in range(len(names), 0, -1):
        group = list(held.values())[:len(keys) + level]
        earlier = Window.partitionBy(*group[:-1]).orderBy(group[-1]).rowsBetween(Window.unboundedPreceding, -1)
        own = sizes if level == len(names) else sizes.groupBy(*group).agg(F.sum("_weight").alias("_weight"))
        before = own.select(*group, F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_before"))
        if totals is None:
            totals = before
            continue
        above = before.select(*[F.col(g).alias(f"_u{g}") for g in group], F.col("_before").alias("_above"))
        same = reduce(lambda x, y: x & y, (F.col(g).eqNullSafe(F.col(f"_u{g}")) for g in group))
        totals = totals.join(above, same).select(*held.values(), (F.col("_before") + F.col("_above")).alias("_before"))
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(n)) for c, n in held.items()))
    return marked.join(totals, same, "left").drop(*held.values(), *names[:-1])


def by_width(order: str, width: int) -> Column:
    """Blocks of ``width`` consecutive values of a unique integer, named by their first value."""
    value = F.col(order).cast("bigint")
    return value - F.pmod(value, F.lit(width).cast("bigint"))


def by_widths(order: str, width: int) -> list[Column]:
    """Nested blocks of consecutive values: ``SHARES`` blocks of ``width`` in each coarser one."""
    return [by_width(order, width * SHARES), by_width(order, width)]


def _blocks(block: Column | Sequence[Column]) -> list[Column]:
    return [block] if isinstance(block, Column) else list(block)


def blocked_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                block: Column | Sequence[Column], weight: Column | None = None) -> DataFrame:
    """Running total of ``weight`` over the rows before this one, per key.

    Equals a window over the key ordered by ``order``, without bringing a key
    into one task: ``block`` never decreases along ``order`` and its rows fit a
    task; totals run within (key, block), and earlier blocks add their sums.
    Where blocks are too many for one task, ``block`` is a list, coarse to fine.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight.cast("bigint")
    totals = _with_block_totals(df, keys, _blocks(block), weight)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)) + F.col("_before")).drop(
        "_block", "_before")


def blocked_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str,
                 block: Column | Sequence[Column]) -> DataFrame:
    """1-based ``row_number()`` per key, computed like ``blocked_sum``."""
    return blocked_sum(df, keys, order, name, block).withColumn(name, F.col(name) + 1)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a table whose rows were counted and are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_KEYS else df


def split_hot(df: DataFrame, key: str, order: str, limit: int, part: str, whole: str) -> DataFrame:
    """Cut the rows of keys with more than ``limit`` rows into ordered parts 0, 1, …

    ``order`` is a unique integer, so a run of ``limit`` of its values holds at
    most ``limit`` rows; a part is as many runs as fit, at most ``2 * limit`` rows.
    Other keys are part 0 and ``whole``. The keys to cut are counted first,
    reading only the key column. Without any there is no join. Else the parts of
    their runs are stored, and broadcast if a count finds them few.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") > limit)
    hot = materialize(counts.select(F.col(key).alias("_hot")), "hot-keys")
    n = hot.count()
    if n == 0:
        return df.withColumns({part: F.lit(0).cast("bigint"), whole: F.lit(True)})
    runs = (
        df.join(bounded(hot, n), F.col(key).eqNullSafe(F.col("_hot")), "left_semi")
        .groupBy(F.col(key).alias("_hot"), by_width(order, limit).alias("_run")).agg(F.count("*").alias("_rows"))
    )
    wide = by_width("_run", limit * 100_000)
    placed = blocked_sum(runs, ["_hot"], ["_run"], "_earlier", wide, F.col("_rows"))
    parts = materialize(placed.select("_hot", "_run", F.floor(F.col("_earlier") / F.lit(limit)).alias("_part")),
                        "hot-parts")
    same = F.col(key).eqNullSafe(F.col("_hot")) & (by_width(order, limit) == F.col("_run"))
    joined = df.join(bounded(parts, parts.count()), same, "left")
    return joined.withColumns({
        part: F.coalesce("_part", F.lit(0).cast("bigint")), whole: F.col("_part").isNull(),
    }).drop("_hot", "_run", "_part")


def _hash_blocks(rows: int, digits: int, share_rows: int) -> list[Column]:
    """Blocks of ``_h`` by its first digits, ``digits`` more at each level, until a block has ``share_rows`` rows."""
    used = 0
    while rows >> (4 * used) > share_rows and used < HASH_DIGITS:
        used += digits
    return [F.left("_h", F.lit(d)) for d in range(digits, used + 1, digits)] or [F.lit("")]


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str, name: str, digits: int = DIGITS,
              share_rows: int = SHARE_ROWS) -> DataFrame:
    """Position of each row in a repeatable shuffle, 1-based and gap-free.

    ``keys`` must tell rows apart. The rows are counted; the digits of the hash
    cut them into equal nested blocks that fit a task, however many rows there are.
    """
    marked = df.withColumn("_h", hash_order(seed, *keys))
    return blocked_rank(marked, [], ["_h", *keys], name, _hash_blocks(df.count(), digits, share_rows)).drop("_h")


def hash_cut(df: DataFrame, keys: Sequence[str], seed: int | str, ratio: float, name: str, digits: int = DIGITS,
             share_rows: int = SHARE_ROWS) -> DataFrame:
    """True for the first ``int(n * ratio)`` rows of the repeatable shuffle.

    Finds the hash of the last row inside the cut by rounds: the rows that share
    the digits found so far are counted by their next ones, at most ``16 ** digits``
    numbers to the driver, until a share is small enough to sort. Then rows are
    compared with it: they are not shuffled. ``keys`` must tell rows apart.
    """
    marked = df.withColumn("_h", hash_order(seed, *keys))
    prefix, wanted, size = "", None, None
    while size is None or (size > share_rows and len(prefix) < HASH_DIGITS):
        share = F.left("_h", F.lit(len(prefix) + digits))
        counts = sorted(map(tuple, marked.where(F.col("_h").startswith(prefix)).groupBy(share).count().collect()))
        if wanted is None:
            wanted = int(sum(n for _, n in counts) * ratio)
            if wanted <= 0:
                return df.withColumn(name, F.lit(False))
        for prefix, size in counts:  # noqa: B020
            if wanted <= size:
                break
            wanted -= size
    last = marked.where(F.col("_h").startswith(prefix)).select("_h").orderBy("_h").offset(wanted - 1).limit(1)
    return marked.withColumn(name, F.col("_h") <= F.lit(last.first()[0])).drop("_h")


def number_rows(files: DataFrame, name: str = "ord") -> DataFrame:
    """Number the rows of a file scan 1, 2, … in the order of file, split and line.

    ``files`` is the scan itself. One split of a file is one block.
    """
    marked = files.select(
        "*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .alias("_split"), F.monotonically_increasing_id().alias("_line"))
    return blocked_rank(marked, [], ["_line"], name, F.col("_split")).drop("_split", "_line")


def index_from_zero(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """A gap-free index for a catalogue of unique keys, in hash order."""
    return hash_rank(df, [key], "", name).withColumn(name, F.col(name) - 1)
