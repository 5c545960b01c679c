"""The pipeline's stages against brute force on a small corpus with planted cases."""

import random
from collections import Counter

import public_tokenizers

import corpus_pipeline
from echoloom.llm import secret_scan
from tests.llm.test_byte_bpe import brute as brute_tokens
from tests.llm.test_quality_rules import prose
from tests.llm.test_simhash import brute_groups, brute_print


def test_stages(spark, docs, tmp_path):
    rng = random.Random(11)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 150)) for i in range(60)]
    clean = set(range(60))
    rows += [(200 + i, " ".join(w + "###" for w in prose(rng).split())) for i in range(8)] + [(300, "short"), (301, None)]
    rows += [(400 + i, rows[i][1]) for i in range(5)]
    rows += [(500 + i, prose(rng, 90) + " " + item.upper() + " " + prose(rng, 30)) for i in range(4)]
    rows += [(600, prose(rng, 80) + ' password = "Hunter2Hunter2" ' + prose(rng, 80))]
    table = docs(rows).select("doc_id", "text", "lang", "source", "n_chars")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, kept, held = dict(rows), [], table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == table.columns, name
        kept.append({r.doc_id: r.text for r in held.collect()})
    assert set(kept[0]) == clean | {400, 401, 402, 403, 404, 500, 501, 502, 503, 600}
    prints = [(d, brute_print(texts[d])) for d in sorted(kept[0])]
    assert set(kept[1]) == set(brute_groups(prints, [texts[d] for d, _ in prints])[1])
    assert set(kept[2]) == clean | {600}
    assert kept[3] == {d: secret_scan.mask(texts[d]) for d in kept[2]} and "Hunter2" not in kept[3][600]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == brute_tokens(list(kept[3].items()))


def test_stage_order_and_empty_table(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE"]
    docs([(1, "x")]).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert public_tokenizers.PATTERN
