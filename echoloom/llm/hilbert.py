"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at exact equal-depth cuts, a row's cell gives its index on the curve, rows are sorted by
it, and the sorted rows are cut into runs of equal row counts. Neighbours on the curve are neighbours in every
dimension, so a shard spans a small box and its file's minimum and maximum prune on each of them.

Law ``rows``: the sizes of any two shards differ by one row at most. Rows in the same cell stand by text digest, so
equal texts stay together as far as the cuts allow; a group larger than a shard is cut, never dropped.

Defined cases: null counts as the smallest value of a dimension and as an empty text; repeated rows and ties take
consecutive slots in the order of the input; an empty table gives no rows; text is only measured and digested.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.ordering import running_totals

DIMENSIONS = ("source", "lang", "size")
BITS = 6


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below ``2 ** bits``.

    Skilling's transposed form: undo the rotations from the top bit down, take the Gray code, interleave the bits.
    """
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(set_, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    index = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ t) >> bit) & 1)
    return index


def depth_cuts(df: DataFrame, name: str, levels: int) -> list:
    """The smallest value of each of ``levels`` equally deep bins of a column but the first, in order.

    Values are counted first, so a value that owns a third of the rows is one row; the counts are summed over all
    rows, in ranges. At most ``levels`` values reach the driver.
    """
    counts = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("rows"))
    totals, total = running_totals(counts, [F.col("value").asc_nulls_first()], {"before": F.col("rows")}, "cuts")
    if not total["before"]:
        return []
    bins = totals.select("value", F.floor(F.col("before") * F.lit(levels) / F.lit(total["before"])).alias("bin"))
    firsts = bins.where(F.col("value").isNotNull() & (F.col("bin") > 0)).groupBy("bin").agg(F.min("value").alias("v"))
    return [r.v for r in firsts.orderBy("bin").collect()]


def hilbert_index(df: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> Column:
    """The curve index of a row, with cuts taken from all rows of ``df``."""
    if bits * len(dimensions) > 62:
        raise ValueError("bits * dimensions must stay below 63")
    cuts = [depth_cuts(df, d, 1 << bits) for d in dimensions]

    def cell(values: pd.Series, at: list) -> np.ndarray:
        known = values.notna().to_numpy()
        out = np.zeros(len(values), np.int64)
        if at and known.any():
            strings = isinstance(at[0], str)
            edges = np.array(at, dtype=object if strings else None)
            got = values[known].to_numpy(dtype=object if strings else None)
            out[known] = np.searchsorted(edges, got, side="right")
        return out

    @F.pandas_udf("bigint")
    def index(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_index(np.stack([cell(c, a) for c, a in zip(columns, cuts)], axis=1), bits))

    return index(*(F.col(d) for d in dimensions))


def shard(docs: DataFrame, n_shards: int = 24, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Every row of ``docs`` with its curve index, shard and slot, under law ``rows``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.withColumns({
        "size": F.octet_length(text).cast("bigint") + 8, "text_crc32": F.crc32(text.cast("binary"))})
    facts = facts.select("doc_id", "size", "text_crc32", *(d for d in dimensions if d != "size"))
    placed = facts.withColumn("curve", hilbert_index(facts, dimensions, bits))
    ranked, total = running_totals(placed, [F.col("curve"), F.col("text_crc32"), F.col("size"), F.col("doc_id")],
                                   {"rank": None}, "shards")
    rows = max(total["rank"], 1)
    # Integer arithmetic: shard s holds the ranks from ceil(s * rows / n_shards) on.
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}) div {n_shards}")
    return (
        ranked.withColumn("shard", F.expr(f"int(rank * {n_shards} div {rows}L)"))
        .withColumn("slot", F.col("rank") - first)
        .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}).drop("rank")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in curve order; large shards are several files, each a run of the curve."""
    order = ["shard", "slot"]
    ranges = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.partitionBy("shard").parquet(path)
