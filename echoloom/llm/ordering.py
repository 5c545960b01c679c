"""Positions in a global order, computed in ranges: no task sees more than its range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoloom.llm.batches import fresh, materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low bits and the partition above them


def running_totals(df: DataFrame, order: Sequence[Column], weights: dict[str, Column | None],
                   label: str = "ordered") -> tuple[DataFrame, dict[str, int]]:
    """``df`` with, per name, the total weight of all rows before this one; and the grand totals.

    A weight of None counts rows. Rows are range-partitioned by ``order`` and stored; one row per range goes to the
    driver. Ties in ``order`` are broken by the position in the input, so equal rows spread over ranges too.
    """
    spark = df.sparkSession
    tie, at, part = fresh(df, "_tie", "_at", "_part")
    held = {name: f"{at}_{i}" for i, name in enumerate(weights)}
    marked = df.withColumns({held[n]: F.lit(1).cast("bigint") if w is None else F.coalesce(w.cast("bigint"), F.lit(0))
                             for n, w in weights.items()}).withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, F.col(tie)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = materialize(
        marked.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, _ROW_BITS).cast("int")),
        label)
    sums = stored.groupBy(part).agg(*(F.sum(c).alias(c) for c in held.values())).orderBy(part).collect()
    total = dict.fromkeys(weights, 0)
    rows = []
    for r in sums:
        rows.append((r[part], *total.values()))
        total = {n: v + r[held[n]] for n, v in total.items()}
    names = [f"{c}_before" for c in held.values()]
    schema = ", ".join([f"`{part}` int", *(f"`{c}` bigint" for c in names)])
    before = spark.createDataFrame(rows, schema)  # one row per range
    inside = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    out = stored.join(F.broadcast(before), part)
    for (name, weight), c, b in zip(weights.items(), held.values(), names):
        here = F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) if weight is None else F.coalesce(
            F.sum(c).over(inside), F.lit(0))
        out = out.withColumn(name, F.col(b) + here)
    return out.drop(tie, at, part, *held.values(), *names), total
