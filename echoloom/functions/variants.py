"""JSON values of any shape as VARIANT columns: each row keeps its own keys and types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ROOT = "$"
NULL = "null"
# What ``schema_of_variant`` says of a value, by its first word.
TEXT, LIST, OBJECT = "STRING", "ARRAY", "OBJECT"


def parse(line: Column) -> Column:
    """The value of a text that is one JSON value and nothing else; null for any other text.

    The parser stops after the first value, so the text is parsed as the first item of a list that ends in a digest of
    the text: whatever follows the value then breaks the list or takes the place of the digest.
    """
    mark = F.xxhash64(line)
    whole = F.try_parse_json(F.concat(F.lit("["), line, F.lit(","), mark.cast("string"), F.lit("]")))
    return F.when(F.try_variant_get(whole, "$[1]", "bigint") == mark, F.try_variant_get(whole, "$[0]", "variant"))


def parse_strict(line: Column) -> Column:
    """Like ``parse``, but the job fails on text that is no JSON value."""
    value = parse(line)
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("MALFORMED JSON: "), F.left(line, F.lit(200)))).cast("variant"))


def _step(key: str) -> str:
    quote = "'" if "'" not in key else '"'
    if quote in key or "\\" in key:
        raise ValueError(f"a path cannot name the key {key!r}")
    return f"[{quote}{key}{quote}]"


def get_path(value: Column, path: str) -> Column:
    """The value at a dotted path, as VARIANT; null where a step is missing or no object. JSON null is a value."""
    return F.try_variant_get(value, ROOT + "".join(map(_step, path.split("."))), "variant")


def kind_is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def as_text(value: Column) -> Column:
    """The text of a JSON string; null for every other value, also for lists and objects."""
    return F.when(kind_is(value, TEXT), F.try_variant_get(value, ROOT, "string"))


def items(value: Column) -> Column:
    """The items of a list as ``array<variant>``; null for every other value."""
    return F.try_variant_get(value, ROOT, "array<variant>")


def _fields(value: Column) -> Column:
    """The fields of an object as ``map<string,variant>``; null for every other value."""
    return F.try_variant_get(value, ROOT, "map<string,variant>")


def set_path(value: Column, path: str, new: Column) -> Column:
    """``value`` with ``new`` (VARIANT, null as JSON null) at a dotted path.

    Parents that are missing or no object are made, row by row; a value that is no object itself stays as it is.
    """
    def build(parts: list[str], held: Column) -> Column:
        if not parts:
            return F.coalesce(new, F.parse_json(F.lit(NULL)))
        key, below = parts[0], parts[1:]
        own = F.coalesce(_fields(held), F.create_map().cast("map<string,variant>"))
        others = F.map_filter(own, lambda k, v: k != key)
        child = build(below, F.try_variant_get(held, ROOT + _step(key), "variant"))
        return F.to_variant_object(F.map_concat(others, F.create_map(F.lit(key), child)))

    return F.when(kind_is(value, OBJECT), build(path.split("."), value)).otherwise(value)


def change_text(value: Column, path: str, change: Callable[[Column], Column],
                each: Callable[[Column], Column] | None = None) -> Column:
    """``value`` with ``change`` of the text at a path, or of each text in the list there; other values stay.

    ``each`` changes an array of texts at once, for changes that cannot run inside ``transform``.
    """
    held = get_path(value, path)
    each = each or (lambda texts: F.transform(texts, change))
    listed = items(held)
    texts = each(F.transform(listed, as_text))
    list_new = F.to_variant_object(F.zip_with(listed, texts, lambda old, new: F.when(
        kind_is(old, TEXT), new.cast("variant")).otherwise(old)))
    text_new = change(as_text(held)).cast("variant")
    return (F.when(kind_is(held, TEXT), set_path(value, path, text_new))
            .when(listed.isNotNull(), set_path(value, path, list_new)).otherwise(value))


def to_line(value: Column) -> Column:
    """A value as one line of JSON; keys in alphabetical order."""
    return F.to_json(value)
