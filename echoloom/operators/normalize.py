"""Read, write and normalise one field of a record, addressed by a dotted path.

A path leads through the columns and structs of a table, and on through the objects of a VARIANT column: there each row
has its own keys and types, and what a path finds is decided row by row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom.functions import variants
from echoloom.functions.text import simple_normalizer

Normalizer = Callable[[Column], Column]


def nfc_normalizer(c: Column) -> Column:
    """Like ``simple_normalizer``, after composing letters and their accents.

    Spark has no Unicode normalisation expression, so this one crosses to
    Python in Arrow batches.
    """
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    return simple_normalizer(compose(c))


def _nfc_each(c: Column) -> Column:
    """``nfc_normalizer`` of each item of an array, in one crossing: Python cannot run inside ``transform``."""
    @F.pandas_udf("array<string>")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda items: None if items is None else [
            None if x is None else unicodedata.normalize("NFC", x) for x in items])

    return F.transform(compose(c), simple_normalizer)


nfc_normalizer.each = _nfc_each


def _type_at(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of the field a path leads to; null when a step is missing or no struct."""
    current: T.DataType = schema
    for part in path.split("."):
        if not isinstance(current, T.StructType) or part not in current.names:
            return None
        current = current[part].dataType
    return current


def _at(path: str) -> Column:
    head, *rest = path.split(".")
    c = F.col(f"`{head}`")
    for part in rest:
        c = c.getField(part)
    return c


def _into_variant(schema: T.StructType, path: str) -> tuple[str, str] | None:
    """The path of the VARIANT column that a path leads into, and the path inside it."""
    parts = path.split(".")
    for n in range(1, len(parts)):
        if isinstance(_type_at(schema, ".".join(parts[:n])), T.VariantType):
            return ".".join(parts[:n]), ".".join(parts[n:])
    return None


def _as_variant(df: DataFrame, value: Column) -> Column:
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.VariantType):
        return value
    nested = isinstance(kind, (T.StructType, T.MapType, T.ArrayType))
    return F.to_variant_object(value) if nested else value.cast("variant")


def get_nested(df: DataFrame, path: str) -> Column:
    """The value at a path, null where the path does not exist; as VARIANT inside a VARIANT column."""
    if inside := _into_variant(df.schema, path):
        return variants.get_path(_at(inside[0]), inside[1])
    return _at(path) if _type_at(df.schema, path) is not None else F.lit(None)


def set_nested(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Set the value at a path; parents that are missing or no struct (no object in a VARIANT column) are made.

    A VARIANT value that is no object itself stays as it is.
    """
    if inside := _into_variant(df.schema, path):
        column, rest = inside
        return set_nested(df, column, variants.set_path(_at(column), rest, _as_variant(df, value)))
    head, *rest = path.split(".")

    def build(parts: list[str], current: Column | None, kind: T.DataType | None) -> Column:
        if not parts:
            return value
        part, below = parts[0], parts[1:]
        fields = {f: current.getField(f) for f in kind.names} if isinstance(kind, T.StructType) else {}
        child = kind[part].dataType if part in fields else None
        fields[part] = build(below, fields.get(part), child)
        return F.struct(*[c.alias(f) for f, c in fields.items()])

    known = head in df.columns
    kind = df.schema[head].dataType if known else None
    return df.withColumn(head, build(rest, F.col(f"`{head}`") if known else None, kind))


def normalize_field(df: DataFrame, path: str = "context",
                    normalizer: Normalizer = simple_normalizer) -> DataFrame:
    """Normalise a string, or each item of a string array; leave others alone.

    Inside a VARIANT column this is decided row by row, item by item. A normaliser
    that runs in Python brings its form for arrays as ``each``.
    """
    if inside := _into_variant(df.schema, path):
        column, rest = inside
        return _put(df, column, variants.change_text(_at(column), rest, normalizer, getattr(normalizer, "each", None)))
    kind = _type_at(df.schema, path)
    if isinstance(kind, T.StringType):
        new = normalizer(_at(path))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        each = getattr(normalizer, "each", lambda c: F.transform(c, normalizer))
        new = each(_at(path))
    else:
        return df
    return _put(df, path, new)


def _put(df: DataFrame, path: str, new: Column) -> DataFrame:
    """Replace the value at a path that exists."""
    head, *rest = path.split(".")
    if rest:
        # A null parent has no such path: withField keeps it null.
        return df.withColumn(head, F.col(f"`{head}`").withField(".".join(rest), new))
    return df.withColumn(head, new)
