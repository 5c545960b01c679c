"""Arrow batches of bounded size, and the columns every operator reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.session import materialize

# Bytes of one Arrow batch on its way to Python; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

MapBatch = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def map_arrow(df: DataFrame, fn: MapBatch, schema: str) -> DataFrame:
    """``mapInArrow`` whose batches are bounded by bytes, not by 10 000 rows of any length."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def doc_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: other columns, whatever their names, never meet an operator."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def blocks(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """(doc ids, texts) of runs of documents of at most ``limit`` bytes; a longer text is a run of its own."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        lengths = pc.binary_length(column(batch, "text")).fill_null(0).to_pylist()
        for doc_id, text, length in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), lengths):
            if ids and size + length > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += length
    if ids:
        yield ids, texts


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash with the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


__all__ = ["BATCH_BYTES", "blocks", "column", "doc_rows", "fresh", "map_arrow", "materialize", "table", "texts_of"]
