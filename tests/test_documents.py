"""Documents cut by many tasks, against ``json.loads`` of the whole."""

import json
import random

import pytest

from echoloom.sources import files
from echoloom.sources.documents import ENTRIES, Documents

AWKWARD = ['a,b', '"', "\\", '\\"', "[{", "}],", "é,ü", "\n", "", "data\": [", "𝄞" * 3, "x" * 700, '","', "\\\\\","]


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "523")
    spark.conf.set("spark.sql.files.openCostInBytes", "50")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(AWKWARD)
    if kind == 2:
        return rng.choice([1, -2.5, True, None])
    if kind == 3:
        return rng.choice([[], {}])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "data", "train", "items"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def record(rng, i):
    return {"n": i, "v": value(rng), "data": [{"n": -1}], "items": rng.choice([[], [1, 2], "x"])}


def dumped(document, rng):
    return json.dumps(document, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


def expected(document):
    """The records of a document by the rule of the reader."""
    if isinstance(document, list):
        return document
    found = [r for key in files.WRAPPERS if isinstance(document.get(key), list) for r in document[key]]
    return found or [document]


def seen(texts):
    return sorted(json.dumps(json.loads(r.value), sort_keys=True) for r in texts.collect())


def want(records):
    return sorted(json.dumps(r, sort_keys=True) for r in records)


def read(spark, path):
    return files._record_texts(spark, str(path), files.WRAPPERS, "document")


@pytest.mark.parametrize("seed", range(3))
def test_random_documents(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    documents = []
    for i in range(4):
        records = [record(rng, n) for n in range(rng.randrange(0, 16))]
        kind = rng.randrange(3)
        document = (records if kind == 0 else record(rng, 7) | {"data": 1} if kind == 1 else
                    {"version": "data", "data": records[:9], "x": value(rng), "train": [], "test": records[9:],
                     "items": "no list"})
        documents.append(document)
        (tmp_path / f"d{i}.json").write_text(dumped(document, rng), encoding="utf8")
    assert seen(read(spark, tmp_path)) == want(r for d in documents for r in expected(d))
    one = tmp_path / "one"
    one.mkdir()
    (one / "all.json").write_text("\n".join(dumped(d, rng) for d in documents), encoding="utf8")
    assert seen(read(spark, one)) == want(r for d in documents for r in expected(d))


def test_many_tasks_read_one_document(spark, tmp_path, small_splits):
    records = [{"n": i, "text": f"number, {i}"} for i in range(400)]
    path = tmp_path / "x.json"
    path.write_text(json.dumps({"data": records}))
    found = Documents(spark, str(path), ("data",))
    assert len(found.starts) > 20 and found.whole() is None
    rows = found.records().collect()
    assert [json.loads(r.value) for r in sorted(rows, key=lambda r: (r.block, r.n))] == records
    assert found.records().rdd.getNumPartitions() > 20


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    records = [{"n": 1}, {"n": 2, "text": ",".join(["word"] * 900), "more": list(range(300))}, {"n": 3}]
    (tmp_path / "x.json").write_text(json.dumps(records))
    assert seen(read(spark, tmp_path)) == want(records)


def test_entries(spark, tmp_path, small_splits):
    answers = {f'q{i}"{i},': rng for i, rng in enumerate(AWKWARD * 5)}
    (tmp_path / "p.json").write_text(json.dumps(answers, ensure_ascii=False), encoding="utf8")
    got = files.read_predictions(spark, str(tmp_path / "p.json")).collect()
    assert {r.id: r.prediction for r in got} == answers
    numbers = {f"n{i}": [i, i + 1] for i in range(90)}
    (tmp_path / "n.json").write_text(json.dumps(numbers, indent=2))
    got = files.read_json_entries(spark, str(tmp_path / "n.json"), "array<int>").collect()
    assert {r.key: r.value for r in got} == numbers
    (tmp_path / "e.json").write_text("{}")
    assert Documents(spark, str(tmp_path / "e.json"), mode=ENTRIES).records().count() == 0


def test_lists_by_key(spark, tmp_path, small_splits):
    (tmp_path / "l.json").write_text(json.dumps({"a": ["x", "y,"] * 40, "no": ["z"], "b": [], "c": ["w"]}))
    got = files.read_json_lists(spark, str(tmp_path / "l.json"), ("a", "b", "c"), "string").collect()
    assert sorted((r.key, r.value) for r in got) == sorted([("a", v) for v in ["x", "y,"] * 40] + [("c", "w")])


@pytest.mark.parametrize("text", ['{"data": [{"n": 1}', '[{"n": 1}', '[{"n": "1]', '[{"n": 1}] more', 'not json',
                                  '[{"n": 1},]', '[{"n": 1} {"n": 2}]', '[,{"n": 1}]', '{"data": [{"n": 1}]}}'])
def test_corrupt_documents_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        files.read_json_records(spark, str(tmp_path / "x.json"), "n int").collect()


def test_nested_wrapper_fields_stay_records(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id":"a","items":[{"id":"z"}]},{"id":"b"}]')
    for schema in ("id string", None):
        got = files.read_json_records(spark, str(tmp_path / "x.json"), schema)
        assert sorted(r.id for r in got.collect()) == ["a", "b"]
    lines = tmp_path / "x.lines"
    lines.write_text('[{"id":"a","items":[{"id":"z"}]},{"id":"b"}]\n{"id":"c","items":"no list"}\n')
    got = files.read_json_records(spark, str(lines), "id string", layout="lines")
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c"]
