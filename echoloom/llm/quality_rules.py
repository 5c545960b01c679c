"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule looks at whole-text counts and votes *bad*, *good* or nothing. A document's votes form one of
``3 ** len(RULES)`` patterns, so the corpus reduces to a table of pattern counts whose size does not depend
on the corpus; expectation-maximisation runs on that table and covers all documents. For each rule it estimates

* the share of clean documents, among those the rule votes on, that it calls bad, and
* that share for each of several kinds of junk,

held at better than chance, so a document without a bad vote is never less likely clean than the corpus.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows get equal rows; an
empty table gives an empty table; a very long text is read whole, its counts need memory in proportion to it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, fresh, map_arrow, materialize, texts_of

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# No estimate is surer than this, so no single vote decides against all others for ever.
MOST = 0.999
BAD, ABSTAIN, GOOD = 0, 1, 2

_ENDED = re.compile(rb"[.!?:;\"')\]][ \t\x0b\x0c\r]*$")
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended",
            "n_upper", "n_marks", "n_distinct")


def repeat_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(ids)
    if n < 4:
        return 0
    ids = ids.astype(np.int64)
    pairs = ids[:-1] * (int(ids.max()) + 1) + ids[1:]
    # Numbering the pairs keeps the code of three words below 2 ** 62 for any text.
    pair_ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pair_ids[:-1] * (int(ids.max()) + 1) + ids[2:]
    _, where, counts = np.unique(codes, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def features(text: str) -> tuple[int, ...]:
    """The counts of ``FEATURES`` for one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    return (
        n,
        len(text) - sum(raw.count(bytes((b,))) for b in BLANKS),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(ids) if len(seen) < n else 0,
        len(lines),
        sum(1 for line in lines if _ENDED.search(line)),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        text.count("!") + text.count("?"),
        len(seen),
    )


def _banded(value: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN))


# Each rule maps the columns of FEATURES (as floats) to votes. Order is part of the vote code.
RULES: tuple[tuple[str, Callable[[dict[str, np.ndarray]], np.ndarray]], ...] = (
    ("symbols", lambda f: _banded(r := f["n_symbols"] / f["chars"], r > 0.03, r < 0.005)),
    ("shouting", lambda f: _banded(r := f["n_upper"] / f["words"], r > 0.3, r < 0.1)),
    ("marks", lambda f: _banded(r := f["n_marks"] / f["words"], r > 0.25, r < 0.1)),
    ("repeats", lambda f: _banded(r := f["n_repeat_words"] / f["words"], r > 0.4, r < 0.15)),
    ("lines", lambda f: _banded(r := f["n_dup_lines"] / f["lines"], (r > 0.5) & (f["n_lines"] > 3),
                                (r < 0.1) & (f["n_lines"] > 3))),
    ("variety", lambda f: _banded(r := f["n_distinct"] / np.sqrt(f["words"]), (r < 1.5) & (f["n_words"] >= 20), r > 4)),
    ("word_length", lambda f: _banded(r := f["word_chars"] / f["words"], (r < 2) | (r > 15), (r > 3) & (r < 10))),
    ("sentences", lambda f: _banded(r := f["n_ended"] / f["lines"], (r < 0.1) & (f["n_lines"] > 3), r > 0.7)),
)


def votes(counts: np.ndarray) -> np.ndarray:
    """One vote code per row of ``FEATURES`` counts: base-3 digits, first rule first."""
    f = {name: counts[:, i].astype(float) for i, name in enumerate(FEATURES)}
    f |= {"words": np.maximum(f["n_words"], 1), "chars": np.maximum(f["word_chars"], 1),
          "lines": np.maximum(f["n_lines"], 1)}
    code = np.zeros(len(counts), np.int64)
    for _, rule in RULES:
        code = code * 3 + rule(f)
    return code


def failed_base(counts: np.ndarray) -> np.ndarray:
    words, repeats = counts[:, 0], counts[:, FEATURES.index("n_repeat_words")]
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.int64).reshape(len(texts), len(FEATURES))


def vote_table(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the five base counts, base_failed and the vote code."""
    def run(batches):
        for batch in batches:
            c = _counts(texts_of(batch))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c[:, i]) for i in range(5)), pa.array(failed_base(c)),
                 pa.array(votes(c))], names)

    names = ["doc_id", *FEATURES[:5], "base_failed", "votes"]
    return map_arrow(doc_rows(docs), run, "doc_id long, n_words long, word_chars long, n_symbols long, "
                     "n_dup_lines long, n_repeat_words long, base_failed boolean, votes long")


def vote_digits(codes: np.ndarray) -> np.ndarray:
    """The votes behind each code, one column per rule."""
    powers = 3 ** np.arange(len(RULES) - 1, -1, -1)
    return codes[:, None] // powers % 3


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over pattern counts.

    Returns the share of each class and, per class and rule, the probability that a vote is bad. Class 0 is clean;
    the others are kinds of junk, one for each rule to start with, because junk of one kind passes most rules of
    another and a single junk class would lose the kind that only one rule sees.
    """
    digits, weight = vote_digits(codes), counts.astype(float)
    good, bad = (digits == GOOD).astype(float), (digits == BAD).astype(float)
    # Starts from all-must-pass: junk of the kind of its first bad vote; the counts then correct rules and documents.
    kind = np.where(bad.any(axis=1), bad.argmax(axis=1) + 1, 0)
    member = np.eye(len(RULES) + 1)[kind]
    before = -np.inf
    for _ in range(rounds):
        w = member * weight[:, None]
        share = (w.sum(axis=0) + 0.01) / (w.sum() + 0.01 * w.shape[1])
        share[0] = max(share[0], 0.5)
        share[1:] *= (1 - min(share[0], MOST)) / share[1:].sum()
        # A pseudo-vote of each sort keeps the estimates inside (0, 1).
        wrong = (w.T @ bad + 0.01) / (w.T @ (good + bad) + 0.02)
        wrong[0] = np.clip(wrong[0], 1 - MOST, 0.5)
        wrong[1:] = np.clip(np.maximum(wrong[1:], wrong[0]), 0, MOST)
        member, likelihood = _members(good, bad, share, wrong)
        total = float(weight @ likelihood)
        if total - before < 1e-9 * abs(total):
            break
        before = total
    return share, wrong


def _members(good, bad, share, wrong) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each class per pattern, and the log-likelihood of the pattern."""
    odds = np.log(share) + good @ np.log1p(-wrong).T + bad @ np.log(wrong).T
    top = odds.max(axis=1, keepdims=True)
    scaled = np.exp(odds - top)
    total = scaled.sum(axis=1, keepdims=True)
    return scaled / total, (top + np.log(total)).ravel()


def pattern_posteriors(voted: DataFrame) -> dict[int, float]:
    """Probability of a clean document for each vote code seen in ``voted``.

    At most ``3 ** len(RULES)`` rows reach the driver, whatever the number of documents.
    """
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not rows:
        return {}
    codes, counts = (np.array(x, np.int64) for x in zip(*sorted((r.votes, r.n) for r in rows)))
    digits = vote_digits(codes)
    found, _ = _members((digits == GOOD).astype(float), (digits == BAD).astype(float), *fit(codes, counts))
    return dict(zip(codes.tolist(), found[:, 0].tolist()))


def score_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Base counts, the posterior ``p_clean`` and ``kept`` per row of ``docs``."""
    voted = materialize(vote_table(docs), "votes")
    found = pattern_posteriors(voted)
    # Bounded by the number of vote patterns, not by the data.
    weights = docs.sparkSession.createDataFrame(list(found.items()), "votes long, p_clean double")
    return voted.join(F.broadcast(weights), "votes").select(
        "doc_id", *FEATURES[:5], "base_failed", "p_clean",
        (~F.col("base_failed") & (F.col("p_clean") >= threshold)).alias("kept"))


def keep_quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the posterior, all columns unchanged.

    The text is read twice instead of moving it through a join: once for the pattern counts, once to filter.
    """
    found = pattern_posteriors(vote_table(docs))
    (text,) = fresh(docs, "text_of_rules")

    def run(batches):
        for batch in batches:
            c = _counts(texts_of(batch, text))
            likely = np.array([found.get(v, 1.0) >= threshold for v in votes(c).tolist()], bool)
            keep = pa.array(likely & ~failed_base(c))
            yield batch.select(names).filter(keep)

    names = docs.columns
    return map_arrow(docs.withColumn(text, F.col("text").cast("string")), run, docs.schema)
