"""JSON readers for question records, context dictionaries, documents and predictions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.functions import variants
from echoloom.functions.text import py_strip
from echoloom.sources.documents import ENTRIES, Documents

Schema = T.StructType | str
Input = str | DataFrame

QUESTION_SCHEMA = ("id string, uit_id string, title string, context string, context_id string, question string, "
                   "answers struct<text:array<string>,answer_start:array<bigint>>")
CONTEXT_SCHEMA = "context_id string, context string"
QAS = ("array<struct<id:string,question:string,"
       "answers:array<struct<text:string,answer_start:bigint>>,is_impossible:boolean,at:bigint>>")
ARTICLE = f"title:string,paragraphs:array<struct<context:string,qas:{QAS}>>"
DOCUMENT_SCHEMA = f"version string, data array<struct<{ARTICLE}>>"

# Fields of a JSON document that may hold the list of records.
WRAPPERS = ("data", "examples", "records", "items", "train", "validation", "test")


def _struct(schema: Schema) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def _inferred(values: DataFrame) -> T.StructType:
    """All keys of the records; numbers of two types are doubles, a key of two other types is text."""
    found = values.agg(F.schema_of_variant_agg(F.parse_json("value"))).first()[0] or "OBJECT<>"
    if not found.startswith("OBJECT<"):
        raise ValueError("the records are no objects")
    # How the function names types.
    kind = T.StructType.fromDDL(found[7:-1].replace("OBJECT<", "STRUCT<").replace("VOID", "STRING"))

    def plain(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(plain(t.elementType))
        if isinstance(t, T.DecimalType):
            return T.DoubleType() if t.scale else T.LongType() if t.precision < 19 else t
        return T.StringType() if isinstance(t, T.VariantType) else t

    return plain(kind)


def _kind(ddl: str) -> T.DataType:
    return T.StructType.fromDDL(f"v {ddl}").fields[0].dataType


def _typed(values: DataFrame, schema: T.DataType, *kept: str) -> DataFrame:
    """``r`` of the JSON texts ``value``; a text that is not one such record fails the job."""
    one = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(schema), {"mode": "FAILFAST"})
    checked = F.when(F.size(one) == 1, F.get(one, F.lit(0))).otherwise(F.raise_error(
        F.concat(F.lit("MALFORMED record: "), F.left("value", F.lit(200)))).cast(schema))
    return values.select(*kept, checked.alias("r"))


def read_jsonl(spark: SparkSession, source: Input, schema: Schema | None) -> DataFrame:
    """One record per line. Blank lines are skipped; a bad line fails the job.

    Without a schema all keys are kept, for one more pass over the file.
    """
    if isinstance(source, DataFrame):
        return source
    reader = spark.read.option("mode", "FAILFAST")
    return (reader if schema is None else reader.schema(_struct(schema))).json(source)


def read_jsonl_lenient(spark: SparkSession, source: Input, schema: Schema | None = None) -> tuple[DataFrame, DataFrame]:
    """Readable records, and the text of the lines that are not (``line``).

    Without a schema a record is one VARIANT column, ``record``: it keeps all keys, and each row its own types. With one,
    keys outside it are dropped, and a list or object where text is due is its JSON text.
    """
    if isinstance(source, DataFrame):
        return source, spark.createDataFrame([], "line string")
    lines = spark.read.text(source).where(F.length(py_strip("value")) > 0)
    if schema is None:
        # Of a key that occurs twice the last value counts.
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        parsed = lines.select("value", variants.parse(F.col("value")).alias("record"))
        bad = F.col("record").isNull()
        return parsed.where(~bad).select("record"), parsed.where(bad).select(F.col("value").alias("line"))
    fields = _struct(schema)
    marked = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json(
        "value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select(*[f"r.{f}" for f in fields.names]), parsed.where(bad).select(
        F.col("value").alias("line"))


def read_jsonl_with_keys(spark: SparkSession, path: str, schema: Schema, keys: str = "keys") -> DataFrame:
    """One record per line and the names of the keys it has.

    A typed read turns a missing key and an explicit null both into null; the
    extra column tells them apart. A bad line fails the job.
    """
    fields = _struct(schema)
    lines = spark.read.text(path).where(F.length(py_strip("value")) > 0)
    record = F.from_json("value", fields, {"mode": "FAILFAST"})
    return lines.select(record.alias("r"), F.json_object_keys("value").alias(keys)).select("r.*", keys)


def _record_texts(spark: SparkSession, source: str, wrappers: tuple[str, ...], layout: str) -> DataFrame:
    """``value``, the JSON text of each record of the documents below ``source``."""
    if layout == "document":
        found = Documents(spark, source, wrappers)
        values, own = found.records().select("value"), found.whole()
        return values if own is None else values.unionByName(own.select("value"))
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    lines = spark.read.text(source).where(F.length(py_strip("value")) > 0)
    document = lines.select(variants.parse_strict(F.col("value")).alias("d"))
    none = F.array().cast("array<variant>")
    listed = F.concat(*[F.coalesce(variants.items(variants.get_path(F.col("d"), w)), none) for w in wrappers])
    records = F.coalesce(variants.items(F.col("d")), F.when(F.size(listed) > 0, listed), F.array("d"))
    return document.select(F.explode(records).alias("v")).select(variants.to_line(F.col("v")).alias("value"))


def read_json_records(spark: SparkSession, source: Input, schema: Schema | None,
                      wrappers: tuple[str, ...] = WRAPPERS, layout: str = "document") -> DataFrame:
    """Records of a JSON list, of the lists under known fields of an object, or the object itself.

    The lists are concatenated in the order of ``wrappers``; if none holds a record, the object is the record. Only the
    document's own fields are looked at: a record may have a field of such a name. ``layout="document"`` reads JSON
    values of any size by many tasks; ``layout="lines"`` reads one document per line. Without a schema all keys are
    kept, for one more pass. A corrupt or partial document, or a record of other types, fails the job.
    """
    if isinstance(source, DataFrame):
        return source
    values = _record_texts(spark, source, wrappers, layout)
    return _typed(values, _inferred(values) if schema is None else _struct(schema)).select("r.*")


def read_contexts(spark: SparkSession, source: Input, layout: str | None = None) -> DataFrame:
    """A context dictionary: ``{"contexts": […]}`` for ``.json``, else one record per line."""
    if isinstance(source, DataFrame):
        return source
    if layout is None and not source.lower().endswith(".json"):
        return read_jsonl(spark, source, CONTEXT_SCHEMA)
    return read_json_records(spark, source, CONTEXT_SCHEMA, ("contexts",), layout or "document")


def read_id_set(spark: SparkSession, source: Input, layout: str | None = None) -> DataFrame:
    """Distinct context ids of a list, an object, ``{"contexts": […]}`` or lines."""
    if isinstance(source, DataFrame):
        found = source
    elif layout is None and not source.lower().endswith(".json"):
        found, _ = read_jsonl_lenient(spark, source, "context_id string")
    else:
        found = read_json_records(spark, source, "context_id string", ("contexts",), layout or "document")
    return found.select("context_id").where(F.col("context_id").isNotNull()).distinct()


def read_splits(spark: SparkSession, sources: Mapping[str, Input], schema: Schema | None = QUESTION_SCHEMA) -> DataFrame:
    """Several splits as one table with a ``split`` column."""
    tables = [read_jsonl(spark, s, schema).withColumn("split", F.lit(name)) for name, s in sources.items()]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.unionByName(table, allowMissingColumns=True)
    return whole


def read_qa_documents(spark: SparkSession, source: Input, layout: str = "document") -> DataFrame:
    """``title, paragraphs`` of nested question documents; a corrupt or partial one fails the job.

    Questions written by line carry their place in the whole as ``at``.
    """
    if isinstance(source, DataFrame):
        return source
    if layout == "document":
        return _typed(Documents(spark, source, ("data",)).records().select("value"), _struct(ARTICLE)).select("r.*")
    read = spark.read.schema(DOCUMENT_SCHEMA).option("mode", "FAILFAST")
    return read.json(source).select(F.inline("data"))


def read_json_lists(spark: SparkSession, source: str, keys: tuple[str, ...], kind: str) -> DataFrame:
    """``key, value`` of the lists that a document has under ``keys``, item by item; ``kind`` is the items' type."""
    found = Documents(spark, source, keys).records()
    return _typed(found.withColumnRenamed("label", "key"), _kind(kind), "key").select("key", F.col("r").alias("value"))


def read_json_entries(spark: SparkSession, source: str, kind: str, layout: str = "document") -> DataFrame:
    """``key, value`` of JSON objects, entry by entry; ``kind`` is the values' type.

    ``layout="lines"`` reads one object per line.
    """
    if layout == "document":
        entries = Documents(spark, source, mode=ENTRIES).records()
        text = entries.select(F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
    else:
        text = spark.read.text(source).where(F.length(py_strip("value")) > 0)
    return _typed(text, T.MapType(T.StringType(), _kind(kind))).select(F.explode("r").alias("key", "value"))


def read_predictions(spark: SparkSession, source: Input, layout: str = "document") -> DataFrame:
    """``id, prediction`` of a JSON object from question id to answer.

    ``layout="lines"`` reads one object per line; a document is read entry by entry.
    """
    if isinstance(source, DataFrame):
        return source
    return read_json_entries(spark, source, "string", layout).select(
        F.col("key").alias("id"), F.col("value").alias("prediction"))
