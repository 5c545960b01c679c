import random
import zlib
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import hilbert as ops
from tests.llm.conftest import AWKWARD


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_in_single_steps(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = ops.curve_index(grid, bits)
    assert sorted(index) == list(range(1 << bits * n))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cuts_are_exact_quantiles(spark):
    rng = random.Random(1)
    values = sorted(rng.choice([rng.randrange(50), 7]) for _ in range(1000))
    df = spark.createDataFrame([(v,) for v in values], "v long")
    want, seen = {}, Counter(values)
    before = 0
    for v in sorted(seen):
        want.setdefault(before * 8 // 1000, v)
        before += seen[v]
    assert ops.depth_cuts(df, "v", 8) == [v for b, v in sorted(want.items()) if b > 0]


@pytest.mark.parametrize("many", [0, 500])
def test_shards_are_even_and_gapless(docs, many):
    rng = random.Random(2)
    rows = AWKWARD + [(i, "t" * rng.randrange(40), rng.choice(["en", "de", None]), f"s{rng.randrange(9)}")
                      for i in range(many)] + [(i, "same", "en", "hot") for i in range(many)]
    got = ops.shard(docs(rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    along = [r.curve for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)


def test_empty_table(docs):
    assert ops.shard(docs([(1, "x")]).where("false")).count() == 0


def test_files_prune_on_every_dimension(docs, spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(1, 400), rng.choice(["de", "en", "es", "fr"]), f"s{rng.randrange(30):02}")
            for i in range(2000)]
    ops.write_shards(ops.shard(docs(rows)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 2000
    spans = back.groupBy("shard").agg({"source": "min", "size": "min"}).collect()
    tops = {r.shard: r for r in back.groupBy("shard").agg({"source": "max", "size": "max"}).collect()}
    for name, value in (("source", "s05"), ("size", 60)):
        read = sum(r[f"min({name})"] <= value <= tops[r.shard][f"max({name})"] for r in spans)
        assert read <= 14
