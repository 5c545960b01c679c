import random
import time
from collections import Counter

import numpy as np
import pytest

from echoloom.llm import language as ops
from tests.llm.conftest import AWKWARD

SYLLABLES = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "ein", "ich"], "fr": ["eau", "que", "ois", "ère"]}


def say(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 3))) for _ in range(n))


def tables(spark, docs, rng):
    rows = [(i, say(rng, lang, 60), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 8)]
    rows += [(*r, None, None) for r in AWKWARD if r[1]]
    rows = [r for r in rows if r[2] or rng.random() < 2]
    pages, truth = [], {}
    for i in range(150):
        lang = rng.choice(list(SYLLABLES))
        host = rng.choice([f"www.{lang}-site.org", f"{lang}.example.com", "mixed.example.com", f"a.b.{lang}"])
        declared = rng.choice([f' lang="{lang}"', f" lang='{lang}-XX'", "", ' lang="en"'])
        text = say(rng, lang, rng.choice([0, 1, 3, 40]))
        pages.append((i, rng.choice([f"http://{host}/x", f"https://u@{host.upper()}:80?y"]),
                      f"<!DOCTYPE html><html{declared}><script>the the</script><!-- the --><p>{text}&amp;</p></html>"))
        truth[i] = lang
    pages += [(None, None, None), (900, "", ""), (901, "no address", "<p>"), (902, "http://x.de/", None), pages[0]]
    return docs(rows), spark.createDataFrame([(*p, 1, "q") for p in pages],
                                             "page_id long, url string, html string, p int, prior string"), rows, pages, truth


def brute(rows, pages):
    langs = sorted({r[2] for r in rows if r[2] and r[1] is not None})
    counts = {lang: Counter() for lang in langs}
    for r in rows:
        if r[2] and r[1] is not None:
            counts[r[2]].update(ops.trigrams(r[1]).tolist())
    log = {lang: lambda b, c=c, t=sum(c.values()): np.log((c[b] + .5) / (t + .5 * ops.BUCKETS)) for lang, c in counts.items()}
    facts = []
    for _, url, page in pages:
        grams = ops.trigrams(ops.visible_text(page)).tolist()
        scale = min(1, ops.EVIDENCE / len(grams)) if grams else 0
        logs = np.array([sum(log[lang](b) for b in grams) * scale for lang in langs])
        p = np.exp(logs - logs.max())
        facts.append((*ops.address(url), ops.declared_language(page), p / p.sum()))
    out = []
    for i, (host, domain, suffix, declared, p) in enumerate(facts):
        others = [f for j, f in enumerate(facts) if j != i]
        prior = np.full(len(langs), 1 / len(langs))
        for at, value in ((None, 1), (1, domain), (0, host)):
            group = [f[4] for f in others if at is None or f[at] == value]
            if value is not None:
                prior = (sum(group, np.zeros(len(langs))) + ops.SMOOTH * prior) / (len(group) + ops.SMOOTH)
        w = p * prior
        for at, value in ((2, suffix), (3, declared)):
            if value is not None:
                kinds = len({f[at] for f in facts if f[at] is not None})
                same = sum((f[4] for f in others if f[at] == value), np.zeros(len(langs)))
                some = sum((f[4] for f in others if f[at] is not None), np.zeros(len(langs)))
                w = w * (same + .5) / (some + .5 * (kinds + 1))
        out.append((pages[i][0], langs[int(w.argmax())], w.max() / w.sum(), declared, host))
    return out


def test_posterior_equals_brute_force(spark, docs):
    documents, pages, rows, raw, truth = tables(spark, docs, random.Random(4))
    got = sorted(ops.identify(pages, documents).collect(), key=lambda r: str(r.page_id))
    want = sorted(brute(rows, raw), key=lambda r: str(r[0]))
    assert [(r.page_id, r.lang, r.declared, r.host) for r in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    assert [r.probability for r in got] == pytest.approx([w[2] for w in want], abs=1e-9)
    right = [r.lang == truth[r.page_id] for r in got if r.page_id in truth]
    by_text = [r.text_lang == truth[r.page_id] for r in got if r.page_id in truth]
    assert np.mean(right) > 0.85 and np.mean(right) > np.mean(by_text) + 0.05


def test_empty_tables(spark, docs):
    documents, pages, *_ = tables(spark, docs, random.Random(5))
    assert ops.identify(pages.where("false"), documents).count() == 0
    assert {r.lang for r in ops.identify(pages, documents.where("false")).collect()} == {None}


def test_address_and_declaration():
    assert ops.address("http://www.a.example.com:80/x") == ("www.a.example.com", "example.com", "com")
    assert ops.address("nowhere") == (None, None, None) == ops.address("http:///x")
    assert ops.declared_language('<html class="x" lang="pt-BR">') == "pt"
    assert ops.declared_language("<html><p lang='de'>") is None


@pytest.mark.parametrize("page", ["<" * 4_000_000, "<script >" * 400_000, "<html " * 600_000, "<!--" * 900_000,
                                  "<style>x" * 400_000 + "</style>", "<a " * 900_000 + ">"])
def test_long_pages_take_linear_time(page):
    start = time.perf_counter()
    ops.visible_text(page)
    ops.declared_language(page)
    assert time.perf_counter() - start < 10


def test_hidden_parts_and_tags():
    page = "<!-- a --><p>x<SCRIPT t>b</script >y<style>c<style>d</style>z<script>e <b>f</b> 1 < 2"
    assert ops.visible_text(page).split() == ["x", "y", "z", "e", "f", "1", "<", "2"]
    assert ops.declared_language('<html><HTML class="a" lang = "de-AT">') == "de"
    assert ops.declared_language("<html x <html lang=fr") == "fr" and ops.declared_language("<html><p lang=en>") is None
