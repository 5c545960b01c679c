"""Language of web pages by Bayesian fusion of what the page says, what it declares and where it lives.

* *Text.* Character trigrams of the visible text, hashed into ``BUCKETS``, under multinomial models counted over all
  documents of known language; the evidence of a long page is scaled to that of ``EVIDENCE`` trigrams, because
  neighbouring trigrams are not independent.
* *Declared language* and *address suffix.* Their likelihoods per language are grouped sums of the pages' text
  posteriors, so a template that declares the wrong language everywhere loses its weight.
* *Host.* The prior is a hierarchy: a host's share of each language, smoothed towards its domain's, that towards the
  share of all pages, each with the weight of ``SMOOTH`` pages.

A page's own text is taken out of every sum it is judged by, so it never confirms itself.

Defined cases: a null or empty page has no text evidence; without an address or a declaration that factor is one;
documents without a language or text teach nothing; without any known language the result is null; equal
probabilities go to the language first in the alphabet; repeated rows count as pages of their own; empty tables give
no rows; long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, map_arrow, materialize, texts_of

BUCKETS = 1 << 14
EVIDENCE = 50
SMOOTH = 5.0
# Weight of an even spread in the models and the likelihoods.
FLOOR = 0.5

_HIDDEN = re.compile(r"<(script|style|noscript|template)\b|<!--", re.I)
_COMMENT = "!"
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template")} | {
    _COMMENT: re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"""\slang\s*=\s*["']?\s*([a-zA-Z]{2,3})\b""", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_LETTERS = re.compile(r"[\W\d_]+")


def _without_hidden(page: str) -> str:
    """The page with a blank for each script, style or comment that is closed; linear, since an end that is not found
    once is not looked for again."""
    out, begin, at, open_ended = [], 0, 0, set()
    while m := _HIDDEN.search(page, at):
        name, at = (m[1] or _COMMENT).lower(), m.end()
        if name in open_ended:
            continue
        if close := _CLOSE[name].search(page, at):
            out += [page[begin:m.start()], " "]
            begin = at = close.end()
        else:
            open_ended.add(name)
    return "".join([*out, page[begin:]])


def visible_text(page: str | None) -> str:
    shown = _without_hidden(page or "")
    end = shown.rfind(">") + 1  # what opens behind it is no tag
    return entities.unescape(_TAG.sub(" ", shown[:end]) + shown[end:])


def declared_language(page: str | None) -> str | None:
    page, at = page or "", 0
    while m := _HTML.search(page, at):
        end = page.find(">", m.end())
        at = end if end >= 0 else len(page)
        if found := _LANG.search(page, m.end(), at):
            return found[1].lower()
    return None


def address(url: str | None) -> tuple[str | None, str | None, str | None]:
    """(host, domain, suffix): the last two labels and the last one."""
    found = _HOST.match(url or "")
    if not found or not (host := found[1].lower().strip(".")):
        return None, None, None
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of the text's words, in lower case, with a blank before and after each."""
    line = " " + _LETTERS.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(1 << 42)) ^ (codes[1:-1] * np.uint64(1 << 21)) ^ codes[2:]
    with np.errstate(over="ignore"):
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(column(batch, "lang").to_pylist(), texts_of(batch)):
            own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
    if counts:
        yield _tally(counts)


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, data in zip(column(batch, "lang").to_pylist(), column(batch, "counts").to_pylist()):
            counts[lang] = counts.get(lang, 0) + np.frombuffer(data, "<i8")
    if counts:
        yield _tally(counts)


def _tally(counts):
    return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.tobytes() for c in counts.values()])],
                                      ["lang", "counts"])


def text_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of each bucket per language), counted over all documents.

    The driver holds ``BUCKETS`` numbers per language; the number of languages does not depend on the corpus.
    """
    known = docs.select(F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"),
                        F.col("text").cast("string").alias("text")).where("lang <> '' and text is not null")
    schema = "lang string, counts binary"
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partial = map_arrow(map_arrow(known, _count, schema).repartition(tasks, "lang", F.spark_partition_id() % 16), _add,
                        schema)
    rows = sorted(map_arrow(partial.repartition(tasks, "lang"), _add, schema).collect())
    counts = np.array([np.frombuffer(r.counts, "<i8") for r in rows], float).reshape(len(rows), BUCKETS) + FLOOR
    return [r.lang for r in rows], np.log(counts / counts.sum(axis=1, keepdims=True))


def text_posterior(text: str, models: np.ndarray) -> np.ndarray:
    """Probability of each language from the text alone, all languages alike beforehand."""
    found = trigrams(text)
    if not len(found):
        return np.full(len(models), 1 / len(models))
    logs = models[:, found].sum(axis=1) * min(1, EVIDENCE / len(found))
    scaled = np.exp(logs - logs.max())
    return scaled / scaled.sum()


def page_facts(pages: DataFrame, models: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared and the text posterior ``p`` per row of ``pages``."""
    sent = pages.sparkSession.sparkContext.broadcast(models)
    names = ["page_id", "host", "domain", "suffix", "declared", "p"]

    def run(batches):
        for batch in batches:
            rows = [(*address(url), declared_language(page), text_posterior(visible_text(page), sent.value).tolist())
                    for url, page in zip(column(batch, "url").to_pylist(), column(batch, "html").to_pylist())]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [column(batch, "page_id"), *(pa.array(c, pa.string()) for c in columns[:4]),
                 pa.array(columns[4], pa.list_(pa.float64()))], names)

    narrow = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    return map_arrow(narrow, run, "page_id long, host string, domain string, suffix string, declared string, "
                     "p array<double>")


def _sums(facts: DataFrame, key: str, n: int) -> DataFrame:
    """Pages and text posterior sums per value of ``key``: a hash aggregate, so a hot host is one row per task."""
    return facts.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"{key}_of")).agg(
        F.count("*").alias(f"{key}_n"), F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias(f"{key}_sum"))


def _blend(sums: str, pages: str, prior: Column) -> Column:
    """Shares of a group without the row itself, smoothed towards ``prior``; the prior where there is no group."""
    others = F.greatest(F.col(pages) - 1, F.lit(0))
    rest = F.zip_with(F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0))), prior,
                      lambda s, b: (s + SMOOTH * b) / (others + SMOOTH))
    return F.when(F.col(sums).isNull(), prior).otherwise(rest)


def _likelihood(sums: str, total: str, kinds: int) -> Column:
    """Share of the pages of each language that show this row's value, without the row itself; one where there is none."""
    own = F.zip_with(F.zip_with(sums, "p", lambda s, p: F.greatest(s - p, F.lit(0.0))),
                     F.zip_with(total, "p", lambda t, p: F.greatest(t - p, F.lit(0.0))),
                     lambda s, t: (s + FLOOR) / (t + FLOOR * (kinds + 1)))
    return F.when(F.col(sums).isNull(), F.transform("p", lambda p: F.lit(1.0))).otherwise(own)


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared and host, per row of ``pages``."""
    languages, models = text_models(docs)
    n = len(languages)
    if not n:
        return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("lang"),
                            F.lit(None).cast("double").alias("probability"),
                            *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "declared", "host")))
    facts = materialize(page_facts(pages, models), "pages")
    every = facts.agg(F.count("*").alias("all_n"), F.array(*(F.sum(F.col("p")[i]) for i in range(n))).alias("all_sum"))
    row = every.first()  # one row
    joined = facts.withColumns({
        "all_n": F.lit(row.all_n), "all_sum": F.array(*(F.lit(v or 0.0) for v in row.all_sum))})
    kinds = {}
    for key in ("host", "domain", "suffix", "declared"):
        sums = _sums(facts, key, n)
        if key in ("suffix", "declared"):
            kinds[key] = sums.count()
        joined = joined.join(sums, F.col(key) == F.col(f"{key}_of"), "left").drop(f"{key}_of")
        if kinds.get(key):
            shown = facts.where(F.col(key).isNotNull()).agg(*(F.sum(F.col("p")[i]) for i in range(n))).first()
            joined = joined.withColumn(f"{key}_all", F.array(*(F.lit(v or 0.0) for v in shown)))
        else:
            joined = joined.withColumn(f"{key}_all", F.col("all_sum"))
    even = F.transform("p", lambda p: F.lit(1.0 / n))
    joined = joined.withColumn("base", _blend("all_sum", "all_n", even))
    joined = joined.withColumn("middle", _blend("domain_sum", "domain_n", F.col("base")))
    joined = joined.withColumn("prior", _blend("host_sum", "host_n", F.col("middle")))
    joined = joined.withColumns({f"{k}_like": _likelihood(f"{k}_sum", f"{k}_all", kinds.get(k, 0))
                                 for k in ("suffix", "declared")})
    weights = F.zip_with(F.zip_with("p", "prior", lambda a, b: a * b),
                         F.zip_with("suffix_like", "declared_like", lambda a, b: a * b), lambda a, b: a * b)
    fused = joined.withColumn("w", weights).withColumn(
        "total", F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).withColumn("top", F.array_max("w"))
    names = F.array(*(F.lit(x) for x in languages))
    best = F.get(names, (F.array_position("w", F.col("top")) - 1).cast("int"))
    told = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return fused.select("page_id", best.alias("lang"), (F.col("top") / F.col("total")).alias("probability"),
                        told.alias("text_lang"), "declared", "host")
