"""String functions with Python's idea of whitespace, punctuation and paths."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# The characters str.strip() and str.split() treat as blank.
PY_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class (Z = Unicode separators).
PY_BLANK_CLASS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The 32 ASCII punctuation marks removed before scoring.
PUNCTUATION = string.punctuation
# Fixed value: os.path.splitext, where leading dots do not start a suffix.
SUFFIX_PATTERN = r"(?<=[^.])\.[^.]*$"


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda that mentions an outer expression would recompute it for every
    element; binding it as a lambda variable keeps the row cost linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(c: ColumnLike) -> Column:
    """``str.strip()``: a scan of both ends, not a regular expression."""
    return F.btrim(col(c), F.lit(PY_BLANKS))


def is_blank(c: ColumnLike) -> Column:
    """True for null and for text that strips to nothing."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def tokens(c: ColumnLike) -> Column:
    """``str.split()``: blank-separated words, none of them empty."""
    return F.array_remove(F.split(col(c), PY_BLANK_CLASS + "+"), "")


def answer_tokens(c: ColumnLike) -> Column:
    """Words that take part in scoring: lower case, punctuation removed."""
    return tokens(F.translate(F.lower(col(c)), PUNCTUATION, ""))


def normalize_answer(c: ColumnLike) -> Column:
    """Lower, drop punctuation, collapse blanks. Articles stay."""
    return F.array_join(answer_tokens(c), " ")


def basename(path: ColumnLike) -> Column:
    return F.substring_index(col(path), "/", -1)


def dirname(path: ColumnLike) -> Column:
    p = col(path)
    head = F.left(p, F.length(p) - F.length(basename(p)))
    return F.when(F.rtrim(head, F.lit("/")) == "", head).otherwise(F.rtrim(head, F.lit("/")))


def stem(path: ColumnLike) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), SUFFIX_PATTERN, "")


def join_path(base: ColumnLike, name: ColumnLike) -> Column:
    """``os.path.join``: an absolute name wins over the base folder."""
    b, n = col(base), col(name)
    return F.when(n.startswith("/"), n).when(b.endswith("/") | (b == ""), F.concat(b, n)).otherwise(
        F.concat(b, F.lit("/"), n)
    )


def has_suffix(path: ColumnLike, suffix: str | None, ignore_case: bool = True) -> Column:
    if suffix is None:
        return F.lit(True)
    p = col(path)
    return F.lower(p).endswith(suffix.lower()) if ignore_case else p.endswith(suffix)


def content_id(c: ColumnLike, length: int = 8) -> Column:
    """``ctx_`` and the first hex digits of the text's md5."""
    return F.concat(F.lit("ctx_"), F.left(F.md5(col(c)), F.lit(length)))


def preview(c: ColumnLike, length: int = 100, always: bool = False) -> Column:
    """First characters and ``...``, by default only for longer text."""
    t = col(c)
    short = F.concat(F.left(t, F.lit(length)), F.lit("..."))
    return short if always else F.when(F.length(t) > length, short).otherwise(t)


def collapse_blanks(c: ColumnLike) -> Column:
    return F.array_join(tokens(c), " ")


def simple_normalizer(c: Column) -> Column:
    """Default transcript normaliser: lower case, single spaces."""
    return collapse_blanks(F.lower(c))


def hash_order(seed: int | str, *keys: ColumnLike) -> Column:
    """A repeatable shuffle key: unlike rand(), a retried task gets it again."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def hash_pick(n: Column, seed: int | str, *keys: ColumnLike) -> Column:
    """Choose one of ``n`` slots (0-based) from a hash of the keys."""
    head = F.conv(F.left(hash_order(seed, *keys), F.lit(8)), 16, 10).cast("bigint")
    return F.try_mod(head, n.cast("bigint"))


def hash_unit(seed: int | str, *keys: ColumnLike) -> Column:
    """A repeatable number in [0, 1) from a hash of the keys."""
    return F.conv(F.left(hash_order(seed, *keys), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)
