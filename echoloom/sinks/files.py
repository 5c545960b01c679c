"""JSON, text and CSV writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.functions.variants import to_line
from echoloom.operators.spread import blocked_rank, by_width
from echoloom.session import materialize


# Keys of the augmentation log.
NOISE_FILES, TRANSFORMED_FILES = "esc50_files", "torch_augmented_files"

# Bytes of a JSON document that one task writes to one file.
PART_BYTES = 128 << 20


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    """One object per line, raw UTF-8, columns in order; replaces ``path``."""
    df.write.mode("overwrite").option("ignoreNullFields", not keep_nulls).json(path)


def write_records(df: DataFrame, path: str, column: str = "record") -> None:
    """A VARIANT column as one JSON value per line, with all keys it has; replaces ``path``."""
    df.select(to_line(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, path: str, frame: list[str], stored: bool = False) -> None:
    """One JSON document below ``path``, from ``order, json`` rows between the texts of ``frame``.

    With more than two texts, ``section`` (0, 1, …) tells after which one a row
    stands; ``join`` is what stands before a row that is not the first of its
    section, a comma by default. The document is written in parts of about
    ``PART_BYTES``, one file each, by as many tasks: the files in the order of
    their names are the document, and ``sources.documents`` reads them as one.
    Unless they come from a ``stored`` table the rows are stored first, to be
    measured.
    """
    sections = rows if "section" in rows.columns else rows.withColumn("section", F.lit(0))
    items = sections if stored else materialize(sections, "document-rows")
    size = items.agg(F.sum(F.octet_length("json"))).first()[0] or 0
    first = F.lit(False)
    for n in range(len(frame) - 1):
        start = items.where(F.col("section") == n).select(F.min("order")).scalar()
        first = first | ((F.col("section") == n) & (F.col("order") == start))
    before = F.col("join") if "join" in items.columns else F.lit(",")
    body = items.select((F.col("section") * 2 + 1).alias("place"), "order", F.when(first, F.col("json"))
                        .otherwise(F.concat(before, F.col("json"))).alias("value"))
    texts = F.array(*[F.struct(F.lit(n * 2).alias("place"), F.lit(text).alias("value"))
                      for n, text in enumerate(frame)])
    ends = rows.sparkSession.range(1, numPartitions=1).select(F.inline(texts))
    whole = body.unionByName(ends, allowMissingColumns=True)
    parts = -(-size // PART_BYTES) or 1
    # Part files bear the number of their range.
    ranges = whole.repartition(1) if parts == 1 else whole.repartitionByRange(parts, "place", "order")
    ranges.sortWithinPartitions("place", "order").select("value").write.mode("overwrite").option(
        "maxRecordsPerFile", 0).text(path)


def write_contexts_json(df: DataFrame, path: str, order: str, layout: str = "document",
                        per_document: int = 10_000) -> None:
    """``{"contexts": […]}`` in ``order``, a unique integer.

    ``layout="lines"`` writes one document of about ``per_document`` contexts per
    line, which readers can split.
    """
    item = F.struct(*[c for c in df.columns if c != order])
    if layout == "document":
        write_document(df.select(F.col(order).alias("order"), F.to_json(item).alias("json")), path,
                       ['{"contexts":[', "]}"])
        return
    ranked = blocked_rank(df, [], [order], "_rank", by_width(order, 100_000))
    documents = (
        ranked.groupBy(F.floor((F.col("_rank") - 1) / F.lit(per_document)).alias("_n"))
        .agg(F.sort_array(F.collect_list(F.struct("_rank", item.alias("c")))).alias("_l"))
        .select(F.transform("_l", lambda x: x["c"]).alias("contexts"))
    )
    documents.select(F.to_json(F.struct("contexts")).alias("value")).write.mode("overwrite").text(path)


def write_qa_documents(documents: DataFrame, path: str, version: str = "v1.0", layout: str = "document",
                       per_line: int = 1000) -> None:
    """Placed questions (``qa.nest``) as nested question documents, ``{"version", "data": […]}``.

    A question opens its paragraph or title if it stands at that one's place, so
    a document is put together from questions, never from whole titles.
    ``layout="lines"`` writes documents of one paragraph and at most ``per_line``
    of its questions, one per line; a question names its place as ``at``, and
    readers put a title together again.
    """
    answers = ["id", "question", "answers"]
    if layout == "document":
        opens = F.col("at") == F.col("paragraph_at")
        begins = F.col("at") == F.col("title_at")
        inside = lambda c: F.to_json(F.struct(c), {"ignoreNullFields": "false"})
        entered = lambda c: F.left(inside(c), F.length(inside(c)) - 1)
        paragraph = F.when(opens, F.concat(entered("context"), F.lit(',"qas":['))).otherwise("")
        title = F.when(begins, F.concat(entered("title"), F.lit(',"paragraphs":['))).otherwise("")
        rows = materialize(documents.select(
            F.struct("title_at", "paragraph_at", "at").alias("order"),
            F.when(begins, "]}]},").when(opens, "]},").otherwise(",").alias("join"),
            F.concat(title, paragraph, F.to_json(F.struct(*answers))).alias("json"), F.lit(0).alias("section")),
            "document-rows")
        end = "]}" if rows.isEmpty() else "]}]}]}"
        write_document(rows, path, [f'{{"version":"{version}","data":[', end], stored=True)
        return
    asked = F.struct("at", *answers)
    lines = documents.groupBy("paragraph_at", by_width("at", per_line).alias("_run")).agg(
        F.any_value("title").alias("title"), F.any_value("context").alias("context"),
        F.sort_array(F.collect_list(asked)).alias("qas"))
    article = F.struct("title", F.array(F.struct("context", "qas")).alias("paragraphs"))
    line = F.struct(F.lit(version).alias("version"), F.array(article).alias("data"))
    lines.select(F.to_json(line).alias("value")).write.mode("overwrite").text(path)


def export_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per ``split``, in one job."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def _entry(value: Column) -> Column:
    """``"id": value`` as it stands inside a JSON object."""
    whole = F.to_json(F.create_map(F.coalesce("id", F.lit("null")), value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _write_lines(entries: DataFrame, path: str) -> None:
    entries.select(F.concat(F.lit("{"), "json", F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def write_predictions(ranked: DataFrame, path: str, null_odds: DataFrame | None = None,
                      layout: str = "document") -> None:
    """``predictions``, ``nbest_predictions`` and ``null_odds`` below ``path``.

    Each is one JSON object keyed by question id, or with ``layout="lines"`` one
    object per question and line. ``ranked`` has ``id, rank,
    text, probability``; ``null_odds`` has ``id, odds``. Ranking is stored once
    and serves all three.
    """
    ranked = materialize(ranked.select("id", "rank", "text", "probability"), "ranked")
    listed = F.sort_array(F.collect_list(F.struct("rank", "text", "probability")))
    plain = F.transform("_l", lambda x: F.struct(x["text"].alias("text"), x["probability"].alias("probability")))
    parts = {
        "predictions_test": (ranked.where(F.col("rank") == 1), F.col("text")),
        "nbest_predictions_test": (ranked.groupBy("id").agg(listed.alias("_l")), plain),
    }
    if null_odds is not None:
        parts["null_odds_test"] = (null_odds, F.col("odds"))
    for name, (rows, value) in parts.items():
        entries = rows.select(F.col("id").alias("order"), _entry(value).alias("json"))
        if layout == "lines":
            _write_lines(entries, f"{path}/{name}")
        else:
            write_document(entries, f"{path}/{name}", ["{", "}"])


def write_augment_log(split: DataFrame, path: str, key: str, order: Column, layout: str = "document") -> None:
    """The files of both augmentation branches (``method``) as one JSON document.

    ``order`` puts the files of a branch in order and tells them apart.
    ``layout="lines"`` writes a document per file, one per line.
    """
    quoted = F.to_json(F.array(key))
    if layout == "lines":
        name = F.when(F.col("method") == "noise", NOISE_FILES).otherwise(TRANSFORMED_FILES)
        _write_lines(split.select(F.concat(F.lit('"'), name, F.lit('":'), quoted).alias("json")), path)
        return
    rows = split.select(F.when(F.col("method") == "noise", 0).otherwise(1).alias("section"), order.alias("order"),
                        F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("json"))
    write_document(rows, path, [f'{{"{NOISE_FILES}":[', f'],"{TRANSFORMED_FILES}":[', "]}"])


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``key = value`` lines by key, from ``key, value``; one line per metric name."""
    line = F.concat("key", F.lit(" = "), F.col("value").cast("string"))
    metrics.orderBy("key").select(line.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_progress(df: DataFrame, path: str) -> None:
    """Training progress as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
