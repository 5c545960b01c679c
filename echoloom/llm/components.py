"""Connected components of an edge table by alternating stars: hooks and shortcuts as joins and group minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.session import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the pairs ``a, b``; the component is its smallest node.

    Each round points all neighbours of a node at the smallest one among them, first the larger neighbours, then
    the smaller ones, until the table stays the same; the number of rounds grows with the logarithm of the longest
    path. Only a count and a checksum reach the driver, and each round is stored, so a lost executor costs one round.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(pairs, "edges")
    before = _mark(pairs)
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(smallest.withColumnRenamed("m", "v")).distinct(), "edges")
        after = _mark(pairs)
        if after == before:
            break
        before = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
