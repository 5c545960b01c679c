from pyspark.sql import functions as F

from echoloom.operators import contexts as ops
from echoloom.operators import normalize


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _records(spark):
    return spark.createDataFrame(
        [(0, " b "), (1, "a"), (2, "b"), (3, "   "), (4, None), (5, "a "), (6, "x")], "n int, context string")


def test_distinct_contexts_in_first_seen_order(spark):
    got = ops.distinct_contexts(_records(spark), "n").orderBy("first_seen").collect()
    assert [(r.context, r.first_seen) for r in got] == [("b", 0), ("a", 1), ("x", 6)]
    assert got[1].context_id == "ctx_0cc175b9"


def test_replace_contexts(spark):
    known = ops.distinct_contexts(_records(spark).where("n < 3"), "n")
    for hot_rows in (None, 1):
        done = ops.replace_contexts(_records(spark), known, hot_rows)
        assert [tuple(r) for r in done.orderBy("n").collect()] == [
            (0, None, "ctx_92eb5ffe", True), (1, None, "ctx_0cc175b9", True), (2, None, "ctx_92eb5ffe", True),
            (3, "   ", None, None), (4, None, None, None), (5, None, "ctx_0cc175b9", True), (6, "x", None, False)]
        assert rows(ops.replace_stats(done)) == [(4, 1, 2)]


def test_last_wins_and_first_seen(spark):
    df = spark.createDataFrame([("k", "old", 1), ("k", "new", 2), ("k", None, 3), ("j", "only", 1), (None, "x", 4)],
                               "k string, v string, n int")
    assert rows(ops.last_wins(df, "k", "v", "n")) == [("j", "only"), ("k", "new")]
    assert rows(ops.first_seen(df.where("k = 'k'"), "k", "n")) == [("k", "old", 1)]


def test_id_lookups(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "context_id string")
    known = spark.createDataFrame([("a", "A"), ("c", "C")], "context_id string, context string")
    assert rows(ops.contexts_to_process(asked, known)) == [("a", "A")]
    assert rows(ops.unresolved_ids(asked, known)) == [("b",)]
    assert rows(ops.filter_by_ids(asked, known.select("context_id"))) == [("a",), ("a",)]
    assert ops.filter_by_ids(asked, None).count() == 4
    assert ops.filter_by_ids(asked, known.where("false").select("context_id")).count() == 4
    assert ops.limit_contexts(asked, 2).count() == 2 and ops.limit_contexts(asked, 0).count() == 4


def test_collisions(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "context_id string")
    assert rows(ops.id_collisions(df)) == [("a", 2)]


def test_normalize_paths(spark):
    df = spark.createDataFrame([((["A  b", None], "T  x"), 7), (None, 8)],
                               "r struct<xs:array<string>,t:string>, n int")
    assert rows(normalize.normalize_field(df, "r.xs").select("n", "r.xs", "r.t")) == [
        (7, ["a b", None], "T  x"), (8, None, None)]
    assert rows(normalize.normalize_field(df, "r.t").select("n", "r.t")) == [(7, "t x"), (8, None)]
    assert normalize.normalize_field(df, "n") is df and normalize.normalize_field(df, "r.none.x") is df


def test_set_nested_makes_parents(spark):
    df = spark.createDataFrame([(("a",), 1), (None, 2)], "r struct<x:string>, n int")
    made = normalize.set_nested(df, "r.deep.leaf", F.col("n"))
    assert rows(made.select("n", "r.x", "r.deep.leaf")) == [(1, "a", 1), (2, None, 2)]
    over = normalize.set_nested(df, "n.leaf", F.lit("v"))
    assert rows(over.select("n.leaf")) == [("v",), ("v",)]
    assert rows(normalize.set_nested(df, "new", F.lit(0)).select("new")) == [(0,), (0,)]
    assert rows(df.select(normalize.get_nested(df, "r.x"), normalize.get_nested(df, "n.x"))) == [
        ("a", None), (None, None)]
