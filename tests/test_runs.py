import random

import pytest
from pyspark.sql import functions as F

from echoloom.functions import signal
from echoloom.operators import augment, runs


def fold(values, patience, delta, minimize):
    """The rule step by step."""
    best = best_step = None
    counter = 0
    for step, m in enumerate(values, 1):
        if not best:
            best, best_step = m, step
        if best and minimize:
            better = m - best < delta
        else:
            better = m - best > delta
        if better:
            best, best_step, counter = m, step, 0
        elif patience is not None:
            if counter < patience:
                counter += 1
            else:
                return best, best_step, step
    return best, best_step, None


SHAPES = {
    "random": lambda rng, n: [rng.randrange(-8, 9) / 2 for _ in range(n)],
    "zeros": lambda rng, n: [rng.choice([0.0, 0.0, 1.0, -1.0]) for _ in range(n)],
    "rising": lambda rng, n: [i / 4 + rng.random() / 8 for i in range(n)],
    "falling": lambda rng, n: [5 - i / 4 for i in range(n)],
    "plateau": lambda rng, n: [float(min(i, 20)) for i in range(n)],
}


@pytest.mark.parametrize("minimize", [False, True])
@pytest.mark.parametrize("delta", [0.0, 0.6, -0.6])
@pytest.mark.parametrize("patience", [None, 0, 3])
def test_early_stopping(spark, patience, delta, minimize):
    rng = random.Random(7)
    data = {}
    for run in range(40):
        shape = list(SHAPES.values())[run % len(SHAPES)]
        data[run] = shape(rng, rng.randrange(1, 70))
    rows = [(run, step, m) for run, ms in data.items() for step, m in enumerate(ms, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "run_id bigint, step int, m double")
    want = {run: fold(ms, patience, delta, minimize) for run, ms in data.items()}
    for width in (5, runs.WIDTH):
        got = runs.early_stopping(df, "m", patience, delta, minimize, width)
        assert {r.run_id: (r.best, r.best_step, r.stop_step) for r in got.collect()} == want


@pytest.mark.parametrize("minimize,delta", [(False, 0.3), (True, -0.3), (False, 0.0)])
def test_long_runs_level_by_level(spark, monkeypatch, minimize, delta):
    """Blocks of blocks; a run that improves at every step leaves summaries of ``patience + 1`` rows."""
    monkeypatch.setattr(runs, "GROUP", 3)
    rng = random.Random(3)
    sign = -1 if minimize else 1
    data = {1: [sign * i / 2 for i in range(1, 300)], 2: [sign * i / 10 for i in range(200)],
            3: [rng.choice([0.0, 1.0, -1.0, 2.0]) for _ in range(250)], None: [float(i % 9) for i in range(120)], 4: [1.0]}
    df = spark.createDataFrame([(r, s, m) for r, ms in data.items() for s, m in enumerate(ms, 1)],
                               "run_id bigint, step int, m double")
    want = {run: fold(ms, 6, delta, minimize) for run, ms in data.items()}
    got = runs.early_stopping(df, "m", 6, delta, minimize, 8)
    assert {r.run_id: (r.best, r.best_step, r.stop_step) for r in got.collect()} == want
    assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()


def test_log_windows(spark):
    df = spark.createDataFrame([(r, s, float(s * r)) for r in (1, 2) for s in range(1, 24)],
                               "run_id bigint, step int, m double")
    got = sorted(tuple(r) for r in runs.logging_window_mean(df, 10).select("run_id", "step", "loss").collect())
    assert got == [(1, 10, 5.5), (1, 20, 15.5), (2, 10, 11.0), (2, 20, 31.0)]
    assert sorted(tuple(r) for r in runs.latest_metrics(df, "m").collect()) == [(1, 23, 23.0), (2, 23, 46.0)]


def test_best_checkpoint(spark):
    df = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0), (1, 3, 5.0), (1, 4, 1.0), (1, 5, 1.0)],
                               "run_id bigint, step int, m double")
    assert tuple(runs.best_checkpoint(df).first()) == (1, 2, 5.0)
    assert tuple(runs.best_checkpoint(df, minimize=True).first()) == (1, 4, 1.0)


def test_batches(spark):
    df = spark.createDataFrame([(i * 7, float(i)) for i in range(10)], "n bigint, v double").repartition(3)
    batched = runs.batch_assign(df, "n", 4, F.floor(F.col("n") / 20))
    assert sorted((r.n // 7, r.batch) for r in batched.collect()) == [(i, i // 4) for i in range(10)]
    assert tuple(runs.mean_of_batch_means(batched, "v").first()) == (pytest.approx((1.5 + 5.5 + 8.5) / 3), 3)


def test_augment_plan(spark):
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("file"))
    clips = spark.createDataFrame([(0, "n0"), (1, "n1")], "idx int, clip string")
    plan = augment.augment_plan(files, clips, "file", sample_rate=8000).collect()
    noisy = [r for r in plan if r.method == "noise"]
    assert len(plan) == 100 and len(noisy) == 33
    assert all(r.clip in ("n0", "n1") and 0.1 <= r.weight <= 1.5 and r.transform is None for r in noisy)
    rest = [r for r in plan if r.method == "transform"]
    assert all(r.clip is None and r.weight is None and r.transform in augment.TRANSFORMS for r in rest)
    wide = augment.augment_plan(files, clips, "file").collect()
    assert augment.PITCH_TRANSFORM in {r.transform for r in wide}
    log = augment.augment_log(spark.createDataFrame(plan, "file string, method string, clip string, weight double, "
                                                    "transform string"), "file", per_line=20).collect()
    assert sorted(f for r in log for f in r["files"]) == sorted(r.file for r in plan)
    assert max(len(r["files"]) for r in log) <= 20


@pytest.mark.parametrize("idx", [[1, 2, 3], [0, 5, 9], [-4, 100, 7]])
def test_augment_plan_takes_any_numbering(spark, idx):
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("file"))
    clips = spark.createDataFrame([(i, f"n{i}") for i in idx], "idx int, clip string")
    plan = augment.augment_plan(files, clips, "file").collect()
    noisy = [r.clip for r in plan if r.method == "noise"]
    assert len(noisy) == 33 and set(noisy) == {f"n{i}" for i in idx}
    assert all(r.clip is None for r in plan if r.method != "noise")
    with pytest.raises(Exception, match="catalogue is empty"):
        augment.augment_plan(files, clips.where("false"), "file").collect()


def test_signals(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0]), ([1.0], [2.0, 9.0]), ([0.0, 0.0], [0.0, 0.0]), ([], [1.0])],
                               "x array<double>, n array<double>")
    got = df.select(signal.rms("x"), signal.match_length("x", "n"), signal.peak_normalize("x"), signal.gain("x", 20),
                    signal.snr_mix("x", "n", 20.0, 0.5)).collect()
    assert got[0][0] == pytest.approx(12.5 ** 0.5) and got[3][0] is None
    assert [list(r[1]) for r in got] == [[1.0, 0.0], [2.0], [0.0, 0.0], []]
    assert [list(r[2]) for r in got[:3]] == [[0.75, 1.0], [1.0], [0.0, 0.0]]
    assert list(got[0][3]) == pytest.approx([30.0, 40.0])
    k = 12.5 ** 0.5 / 10 / (0.5 ** 0.5 + 1e-9) * 0.5
    assert list(got[0][4]) == pytest.approx([3 + k, 4.0])
    assert list(got[2][4]) == [0.0, 0.0]
