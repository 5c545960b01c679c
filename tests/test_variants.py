"""VARIANT records against Python's own JSON and dictionaries."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from echoloom.functions import variants
from echoloom.operators import normalize as ops
from echoloom.sinks import files as sinks
from echoloom.sources import files


def py_get(obj, path):
    for part in path.split("."):
        if not isinstance(obj, dict) or part not in obj:
            return None
        obj = obj[part]
    return obj


def py_set(obj, path, value):
    obj = copy.deepcopy(obj)
    if not isinstance(obj, dict):
        return obj
    *parents, leaf = path.split(".")
    at = obj
    for part in parents:
        if not isinstance(at.get(part), dict):
            at[part] = {}
        at = at[part]
    at[leaf] = value
    return obj


def plain(text):
    return " ".join(text.lower().split())


def py_normal(obj, path):
    value = py_get(obj, path)
    if isinstance(value, str):
        return py_set(obj, path, plain(value))
    if isinstance(value, list):
        return py_set(obj, path, [plain(v) if isinstance(v, str) else v for v in value])
    return obj


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 3 else 5)
    if kind < 2:
        return rng.choice(["A  b", "é\"x\\", "", "1", "null"])
    if kind < 5:
        return rng.choice([1, -2.5, True, None, 12345678901234567890, [], {}])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "c", "d e", "f'g"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.fixture
def records(spark, tmp_path):
    def make(lines):
        path = tmp_path / "lines.jsonl"
        path.write_text("\n".join(lines) + "\n", encoding="utf8")
        return files.read_jsonl_lenient(spark, str(path))
    return make


def values_of(df):
    return sorted((json.loads(r.v) for r in df.select(variants.to_line(F.col("record")).alias("v")).collect()), key=repr)


@pytest.mark.parametrize("path", ["a", "a.b", "a.b.c", "d e.f'g"])
def test_random_records(records, path):
    rng = random.Random(path)
    made = [value(rng) for _ in range(60)] + [{"a": value(rng), "b": 1} for _ in range(60)]
    made += [{"a": {"b": value(rng), "x": [{"k": None}]}} for _ in range(60)]
    good, bad = records([json.dumps(m, ensure_ascii=False) for m in made])
    ordered = lambda found: json.loads(json.dumps(sorted((json.loads(json.dumps(f, sort_keys=True)) for f in found), key=repr)))
    assert bad.count() == 0 and values_of(good) == ordered(made)
    assert values_of(ops.set_nested(good, f"record.{path}", F.lit("new"))) == ordered(
        [py_set(m, path, "new") for m in made])
    assert values_of(ops.set_nested(good, f"record.{path}", F.array(F.lit(1), F.lit(None)))) == ordered(
        [py_set(m, path, [1, None]) for m in made])
    assert values_of(ops.normalize_field(good, f"record.{path}")) == ordered([py_normal(m, path) for m in made])
    got = good.select(F.to_json(ops.get_nested(good, f"record.{path}")).alias("v")).collect()
    assert sorted(json.dumps(py_get(m, path), sort_keys=True) for m in made if py_get(m, path) is not None) == sorted(
        json.dumps(json.loads(r.v), sort_keys=True) for r in got if r.v is not None and r.v != "null")


def test_bad_lines(records):
    lines = ['{"a":1}', '{"a":1} more', '{"a":1},2', '1],[2', '{"a":', "", "  ", "{'a':1}", '{"a":1,"a":2}', "[1]", "null"]
    good, bad = records(lines)
    assert values_of(good) == sorted([{"a": 1}, {"a": 2}, [1], None], key=repr)
    assert sorted(r.line for r in bad.collect()) == sorted(['{"a":1} more', '{"a":1},2', '1],[2', '{"a":', "{'a':1}"])


def test_unknown_keys_and_types_survive_a_round_trip(spark, records, tmp_path):
    made = [{"context": "A  B", "extra": {"n": [1, "x", None]}}, {"context": ["C D", 5]}, {"context": 7, "q": ["q"]}, {}]
    good, _ = records(map(json.dumps, made))
    done = ops.set_nested(ops.normalize_field(good, "record.context"), "record.meta.done", F.lit(True))
    sinks.write_records(done, str(tmp_path / "out"))
    back, bad = files.read_jsonl_lenient(spark, str(tmp_path / "out"))
    want = [py_set(py_normal(m, "context"), "meta.done", True) for m in made]
    assert bad.count() == 0 and values_of(back) == sorted((dict(sorted(w.items())) for w in want), key=repr)


def test_python_normaliser_and_struct_parent(spark):
    df = spark.createDataFrame([('{"t":["E\\u0301 X",3],"s":"E\\u0301"}',)], "j string").select(
        F.struct(F.parse_json("j").alias("v")).alias("p"))
    both = ops.normalize_field(ops.normalize_field(df, "p.v.t", ops.nfc_normalizer), "p.v.s", ops.nfc_normalizer)
    assert json.loads(both.select(F.to_json("p.v")).first()[0]) == {"t": ["é x", 3], "s": "é"}


def test_odd_keys():
    with pytest.raises(ValueError, match="key"):
        variants._step("both'\"")
