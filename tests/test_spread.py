import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from echoloom.operators import spread


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("hot_rows", [None, 10, 1_000_000])
def test_lookup_join_equals_join(spark, how, hot_rows):
    rng = random.Random(1)
    keys = [rng.choice(["hot", "hot", "hot", None, f"k{rng.randrange(40)}"]) for _ in range(3000)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").repartition(6)
    right = spark.createDataFrame([("hot", "H"), (None, "N")] + [(f"k{i}", f"v{i}") for i in range(30)],
                                  "k string, v string")
    got = spread.lookup_join(left, right, "k", how, hot_rows).select("i", "k", "v")
    assert rows(got) == rows(left.join(right, "k", how).select("i", "k", "v"))


@pytest.mark.parametrize("hot_rows", [None, 200])
def test_lookup_join_splits_hot_and_null_keys(spark, hot_rows):
    left = spark.range(0, 8000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.createDataFrame([("hot", "H")], "k string, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = spread.lookup_join(left, right, "k", "left", hot_rows).withColumn("task", F.spark_partition_id())
        per_task = {k: n for k, n in got.where("k = 'hot'").groupBy("task").count().collect()}
        nulls = {k: n for k, n in got.where("k is null").groupBy("task").count().collect()}
        assert got.where("v = 'H'").count() == got.where("k = 'hot'").count() == 2667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(nulls) > 2 and (len(per_task) > 2) == (hot_rows is not None)


def _table(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", None, "b", "c"]), i, rng.randrange(5)) for i in range(2000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at bigint, w int").repartition(5)


def test_blocked_rank_and_sum(spark):
    df = _table(spark)
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at")))
    got = spread.blocked_rank(df, ["k"], ["at"], "n", spread.by_width("at", 64))
    assert rows(got.select("k", "at", "n")) == rows(want.select("k", "at", "n"))
    earlier = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum("w").over(earlier), F.lit(0)))
    got = spread.blocked_sum(df, ["k"], ["at"], "s", spread.by_width("at", 64), F.col("w"))
    assert rows(got.select("k", "at", "s")) == rows(want.select("k", "at", "s"))
    whole = spread.blocked_rank(df, [], ["at"], "n", spread.by_width("at", 100))
    assert all(r.n == r.at + 1 for r in whole.collect())


@pytest.mark.parametrize("broadcast_keys", [0, 100])
def test_split_hot(spark, monkeypatch, broadcast_keys):
    monkeypatch.setattr(spread, "BROADCAST_KEYS", broadcast_keys)
    got = spread.split_hot(_table(spark), "k", "at", 400, "p", "whole").collect()
    groups = {}
    for r in got:
        groups.setdefault((r.k, r.whole, r.p), []).append(r["at"])
    assert len(got) == 2000 and max(map(len, groups.values())) <= 800
    assert {(k, whole) for k, whole, _ in groups} == {("a", False), ("b", True), ("c", True), (None, True)}
    parts = sorted(p for k, _, p in groups if k == "a")
    assert parts == list(range(len(parts))) and len(parts) >= 2
    assert all(max(groups[("a", False, p)]) < min(groups[("a", False, p + 1)]) for p in parts[:-1])
    ordinary = spread.split_hot(_table(spark), "k", "at", 5000, "p", "whole")
    assert ordinary.where("p <> 0 or not whole").count() == 0 and ordinary.count() == 2000


@pytest.mark.parametrize("share_rows", [3, spread.SHARE_ROWS])
@pytest.mark.parametrize("ratio", [0.0, 0.33, 1.0])
def test_hash_rank_and_cut(spark, ratio, share_rows):
    df = spark.range(1003).select(F.concat(F.lit("f"), "id").alias("f")).repartition(4)
    ranked = spread.hash_rank(df, ["f"], 5, "n", 2, share_rows)
    by_rank = [r.f for r in ranked.orderBy("n").collect()]
    assert sorted(r.n for r in ranked.collect()) == list(range(1, 1004))
    cut = {r.f for r in spread.hash_cut(df, ["f"], 5, ratio, "c", 2, share_rows).collect() if r.c}
    assert cut == set(by_rank[:int(1003 * ratio)])


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_nested_blocks(spark, keys):
    df = _table(spark)
    blocks = [spread.by_width("at", w) for w in (600, 120, 20)]
    plain = spread.blocked_sum(df, keys, ["at"], "s", spread.by_width("at", 20), F.col("w"))
    nested = spread.blocked_sum(df, keys, ["at"], "s", blocks, F.col("w"))
    assert sorted(map(str, nested.select("at", "s").collect())) == sorted(map(str, plain.select("at", "s").collect()))
    assert nested.columns == plain.columns


def test_index_from_zero(spark):
    df = spark.createDataFrame([(c,) for c in "abcdef"], "c string")
    assert sorted(r.idx for r in spread.index_from_zero(df, "c").collect()) == list(range(6))


def test_number_rows_in_file_order(spark, tmp_path):
    for name, start in (("a", 0), ("b", 500)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(f'{{"v":{i}}}' for i in range(start, start + 500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        scan = spark.read.schema("v bigint").json(str(tmp_path))
        got = spread.number_rows(scan).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 1000 and all(r.ord == r.v + 1 for r in got)


def test_a_session_that_keeps_hot_keys_together_is_named(spark):
    left, right = spark.range(3).withColumnRenamed("id", "k"), spark.range(2).selectExpr("id as k", "id as v")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        with pytest.warns(UserWarning, match="skewJoin"):
            assert spread.lookup_join(left, right, "k").count() == 3
        assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
