import os.path
import posixpath
import string
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echoloom.functions import scores, text
from echoloom.operators.normalize import nfc_normalizer, normalize_field

# Code points that the engines case alike, with blanks and marks mixed in often.
CHARACTERS = st.one_of(
    st.sampled_from(list(text.PY_BLANKS) + list(string.punctuation) + list("aAbBéßđ")),
    st.characters(min_codepoint=1, max_codepoint=0x2FFF, exclude_categories=("Cs",), exclude_characters="İΣςſ"))
TEXTS = st.lists(st.text(CHARACTERS, max_size=30), min_size=30, max_size=60)


def normal(s):
    return " ".join("".join(c for c in s.lower() if c not in string.punctuation).split())


def f1(p, t):
    p, t = normal(p).split(), normal(t).split()
    same = sum((Counter(p) & Counter(t)).values())
    if not same:
        return 0.0
    precision, recall = same / len(p), same / len(t)
    return 2 * precision * recall / (precision + recall)


def columns(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*exprs).collect()]


def test_blanks_are_pythons():
    every = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(text.PY_BLANKS) == every


@settings(max_examples=12, deadline=None)
@given(TEXTS)
def test_strip_and_tokens(spark, values):
    got = columns(spark, [(v,) for v in values], "s string", text.py_strip("s"), text.tokens("s"),
                  text.normalize_answer("s"), text.is_blank("s"))
    for v, (stripped, words, norm, blank) in zip(values, got):
        assert stripped == v.strip()
        assert list(words) == v.split()
        assert norm == normal(v)
        assert blank == (not v.strip())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b", "A!", "c", "", "đ"]), max_size=12).map(" ".join)] * 2),
                min_size=20, max_size=40))
def test_scores(spark, pairs):
    got = columns(spark, pairs, "p string, t string", scores.token_f1("p", "t"), scores.exact_match("p", "t"),
                  scores.verdict("p", "t"))
    for (p, t), (score, exact, verdict) in zip(pairs, got):
        assert score == f1(p, t)
        assert exact == (normal(p) == normal(t))
        a, b = p.strip(), t.strip()
        assert verdict == ("correct" if a == b else "similar" if a in b or b in a else "incorrect")


def test_both_empty_match_but_score_zero(spark):
    assert columns(spark, [("!", "")], "p string, t string", scores.exact_match("p", "t"),
                   scores.token_f1("p", "t")) == [(True, 0.0)]


def test_best_over_truths(spark):
    rows = [("x y", ["y z", "x y", ""]), ("x", [])]
    got = columns(spark, rows, "p string, ts array<string>", scores.best_scores("p", "ts"),
                  scores.best_over(scores.token_f1, "p", "ts"), scores.best_over(scores.exact_match, "p", "ts"))
    assert got == [((1.0, 1.0), 1.0, 1.0), ((None, None), None, None)]


def test_long_texts_overlap(spark):
    p, t = " ".join(["a"] * 3000 + ["b"] * 10), " ".join(["a"] * 2000 + ["c"] * 4000)
    assert columns(spark, [(p, t)], "p string, t string", scores.token_f1("p", "t")) == [(f1(p, t),)]


def test_paths(spark):
    paths = ["a.wav", "/x/y.b/c.tar.gz", ".hidden", "/x/.hidden.wav", "..a", "noext", "/x/y.z/noext", "/a", "x/", "a.",
             "/"]
    got = columns(spark, [(p,) for p in paths], "p string", text.basename("p"), text.dirname("p"), text.stem("p"),
                  text.join_path(F.lit("/base"), "p"))
    for p, (base, folder, stem, joined) in zip(paths, got):
        assert base == posixpath.basename(p)
        assert folder == posixpath.dirname(p)
        assert stem == os.path.splitext(posixpath.basename(p))[0]
        assert joined == posixpath.join("/base", p)


def test_preview_and_id(spark):
    long = "é" * 120
    got = columns(spark, [(long,), ("short",)], "s string", text.preview("s"), text.preview("s", 50, always=True),
                  text.content_id("s"))
    assert got[0][:2] == ("é" * 100 + "...", "é" * 50 + "...")
    assert got[1] == ("short", "short...", "ctx_4f09daa9")


def test_nfc(spark):
    got = columns(spark, [("Việt  NAM",)], "s string", nfc_normalizer(F.col("s")))
    assert got == [("vi\u1ec7t nam",)]


def test_hash_helpers_repeat(spark):
    df = spark.range(1000).select(
        text.hash_pick(F.lit(7), 1, "id").alias("p"), text.hash_unit(1, "id").alias("u"))
    a, b = [sorted(map(tuple, df.repartition(n).collect())) for n in (1, 5)]
    assert a == b and {p for p, _ in a} == set(range(7)) and all(0 <= u < 1 for _, u in a)


def test_nfc_in_arrays(spark):
    df = spark.createDataFrame([(["Việt  NAM", None],), (None,)], "s array<string>")
    got = normalize_field(df, "s", nfc_normalizer).collect()
    assert [r.s for r in got] == [["việt nam", None], None]
