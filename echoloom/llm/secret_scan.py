"""Secret scans: fixed patterns, and literals bound to sensitive names by a small lexer.

The patterns find assignments to well-known names, access ids and long hex runs. The lexer reads source and
configuration syntax (``name = "x"``, ``"name": "x"``, ``name => 'x'``, ``export NAME=x``, ``a.b["c"] = x``) into
bindings of a name to literals or other names, follows names to the constants bound to them earlier in the
document, joins literals that are added up, and scores each literal by the names it ends up in. A literal that
scores high enough is reported as a ``literal`` span where it stands, even when its own name is harmless.

Defined cases: a null text is empty; an empty text has no spans; repeated rows get equal rows; positions are code
points, ends exclusive; a very long text is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, doc_rows, fresh, map_arrow, texts_of

# The base patterns, by kind, in the order in which equal starts are listed.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "literal")
ASSIGN_LENGTH, ACCESS_LENGTH = 6, 20

# What an ASSIGN match cannot do without, in lower case: spares most texts the slow search.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# How strongly a part of a name speaks for a secret.
NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 1.0,
    "bearer": 0.8, "auth": 0.5, "key": 0.4, "private": 0.4, "access": 0.4, "signing": 0.4, "session": 0.3,
    "connection": 0.3, "api": 0.3, "encryption": 0.4,
}
# Least product of name score and literal score that is reported.
NEEDED = 0.6
# Literals that stand for a secret rather than being one.
PLACEHOLDERS = frozenset(("changeme", "example", "placeholder", "undefined", "password", "secret", "required"))
LITERAL_LENGTH = 6

_LEX = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<bind>:=|=>|==|!=|<=|>=|=|:)"""
    r"""|(?P<add>\+|\.\.)"""
    r"""|(?P<end>[\n;,{}])"""
    r"""|(?P<other>[^\s])""", re.ASCII)
_BARE = re.compile(r"[A-Za-z0-9+/_.=\-]*", re.ASCII)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_PARTS = re.compile(r"[^A-Za-z0-9]+", re.ASCII)
_KEYWORDS = frozenset(("const", "let", "var", "export", "final", "static", "string", "str", "set", "public"))
_BINDS = frozenset(("=", ":", ":=", "=>"))
# Attributes that name what another attribute of the element holds.
_LABELS, _VALUES = frozenset(("key", "name", "id")), frozenset(("value", "content"))
_LEX_HINT = re.compile("|".join(
    ("passw", "passphrase", "pwd", "secret", "token", "api", "credential", "private", "access", "bearer", "auth",
     "key")))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, whole matches, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    if any(hint in (low := text.lower()) for hint in _HINTS):
        del low
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def name_score(name: str) -> float:
    """How likely the name holds a secret: its strongest part, or two neighbouring parts as one word."""
    parts = [p.lower() for piece in _PARTS.split(name) if piece for p in _CAMEL.split(piece) if p]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    known = lambda p: NAME_SCORES.get(p, NAME_SCORES.get(p.removesuffix("s"), 0.0))
    single = [known(p) for p in parts]
    return max([*single, *map(known, joined), min(1.0, sum(sorted(single)[-2:]))], default=0.0)


def literal_score(value: str) -> float:
    """0 for what cannot be a secret, up to 1 for a long mix of letters, digits and marks."""
    if len(value) < LITERAL_LENGTH or any(c.isspace() for c in value) or value.lower() in PLACEHOLDERS:
        return 0.0
    if value.startswith(("$", "<", "%", "{")) or len(set(value)) < 4:
        return 0.0
    kinds = sum(any(test(c) for c in value) for test in (str.islower, str.isupper, str.isdigit))
    kinds += any(not c.isalnum() for c in value)
    return min(1.0, 0.4 + 0.2 * kinds + 0.01 * len(value))


Literal = tuple[int, int, str]


class _Bare:
    """Unquoted literals: runs of characters that one may have, each measured once."""

    def __init__(self, text: str):
        self.text, self.end, self.digit = text, 0, -1

    def at(self, start: int) -> Literal | None:
        """The literal from ``start`` to the end of its run, if long enough and with a digit."""
        text = self.text
        if start >= self.end:
            self.end = _BARE.match(text, start).end()
            self.digit = max(text.rfind(d, start, self.end) for d in "0123456789")
        if self.end - start < LITERAL_LENGTH or self.digit < start:
            return None
        if text[self.end - 1] == "=" and text[self.end:self.end + 1] in ('"', "'", "`"):
            return None  # a name that is bound to the string after it
        return start, self.end, text[start:self.end]


def bindings(text: str) -> Iterator[tuple[list[str], list[Literal], list[str]]]:
    """(target names, literals, names) of each assignment in the text, in order.

    A target is a name or quoted key before a binding sign; ``a = b = "x"`` has two. A value is literals and names
    added up, the arguments of a call or the items of a list; it runs to the end of the line or statement. Of an
    element with a labelled value (``key="x" value="y"``) the label is a target too. An unquoted literal is one token,
    so each character is read a fixed number of times.
    """
    before, targets, literals, names, expect, last, label = "", [], [], [], False, "", ""
    bare, at, inside = _Bare(text), 0, 0
    while m := _LEX.search(text, at):
        kind, got, at = m.lastgroup, m[0], m.end()
        if kind == "bind" and got in _BINDS:
            if targets and last == "name":
                targets.append(names.pop())
            else:
                if literals or names:
                    yield targets, literals, names
                if targets and targets[-1].lower() in _LABELS and literals:
                    label = literals[-1][2]
                targets = [before] if before else []
                if label and before.lower() in _VALUES:
                    targets.append(label)
            literals, names, expect, last, inside = [], [], bool(targets), "", 0
        elif kind == "end" and not (got == "," and inside):
            if targets and (literals or names):
                yield targets, literals, names
            before, targets, literals, names, expect, last, label, inside = "", [], [], [], False, "", "", 0
        elif kind in ("add", "end"):
            expect = bool(targets)
        elif targets and got in ("(", "[") and (expect or last == "name"):
            expect, inside = True, inside + 1
        elif got in (")", "]") and inside:
            expect, inside = False, inside - 1
        elif expect and kind == "string":
            literals.append((m.start() + 1, m.end() - 1, got[1:-1]))
            expect, last, before = False, "string", got[1:-1]
        elif expect:
            if found := bare.at(m.start()):
                literals.append(found)
                last, at = "bare", max(at, found[1])
            if kind == "name":
                names.append(got)
                last, before = "name", got
            expect = False
        elif kind == "name" and got.lower() not in _KEYWORDS:
            before, last = got, last if targets else ""
        elif kind == "string":
            before = got[1:-1]
    if targets and (literals or names):
        yield targets, literals, names


def literal_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that end up in a sensitive name, by way of any number of other names.

    Statements form a graph: each holds its own literals and points at the statements that bound the names it
    uses. A sensitive target walks the graph; a statement is walked again only for a higher name score, so the
    work stays linear in the text.
    """
    if not ("=" in text or ":" in text) or not _LEX_HINT.search(text.lower()):
        return []
    own: list[list[tuple[int, int, float]]] = []
    uses: list[list[int]] = []
    best: list[float] = []
    bound: dict[str, int] = {}
    found: set[tuple[int, int]] = set()
    for targets, literals, names in bindings(text):
        # An unquoted word is a constant where one has that name, else a literal.
        literals = [lit for lit in literals if lit[2] not in bound]
        whole = literal_score("".join(value for _, _, value in literals)) if len(literals) > 1 else 0.0
        own.append([(start, end, max(literal_score(value), whole)) for start, end, value in literals])
        uses.append([bound[name] for name in names if name in bound])
        best.append(0.0)
        for target in targets:
            bound[target] = len(own) - 1
        score = max(map(name_score, targets))
        walk = [len(own) - 1] if score > 0 else []
        while walk:
            at = walk.pop()
            if score <= best[at]:
                continue
            best[at] = score
            found.update((start, end) for start, end, value in own[at] if score * value >= NEEDED)
            walk += uses[at]
    return [(start, end, "literal") for start, end in sorted(found) if end > start]


def spans(text: str) -> list[tuple[int, int, str]]:
    """Base and literal spans of a text, by start, then kind."""
    return sorted([*base_spans(text), *literal_spans(text)], key=_order)


def join_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans, per row of ``docs``."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_literal", "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                found = spans(text)
                n = [sum(s[2] == kind for s in found) for kind in KINDS]
                base = join_spans([s for s in found if s[2] != "literal"])
                rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), join_spans(found)))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]),
                 *(pa.array(c, pa.string()) for c in columns[4:])], names)

    return map_arrow(doc_rows(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, "
                     "base_sha256 string, spans string")


def secret_ranges(text: str) -> list[tuple[int, int]]:
    """Where the secrets themselves stand: of an assignment its value, of other spans all of it; in order, merged."""
    found = [(ASSIGN.match(text, start).start(2) if kind == "assign" else start, end)
             for start, end, kind in spans(text)]
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((start, end))
    return merged


def mask(text: str | None, filler: str = "[SECRET]") -> str | None:
    """The text with every range of ``secret_ranges`` replaced by ``filler``."""
    if not text or not (found := secret_ranges(text)):
        return text
    parts, at = [], 0
    for start, end in found:
        parts += [text[at:start], filler]
        at = end
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, filler: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in ``text`` masked; other columns, and null texts, unchanged.

    ``n_chars``, where present as a whole number, follows the new text.
    """
    (copy,) = fresh(docs, "text_to_mask")

    def run(batches):
        for batch in batches:
            masked = pa.array([mask(t, filler) for t in column(batch, copy).to_pylist()], pa.string())
            out = batch.select(names)
            at = names.index("text")
            columns = [masked if i == at else out.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, schema=out.schema)

    names = docs.columns
    out = map_arrow(docs.withColumn("text", F.col("text").cast("string")).withColumn(copy, F.col("text")), run,
                    docs.withColumn("text", F.col("text").cast("string")).schema)
    kinds = dict(out.dtypes)
    if kinds.get("n_chars") in ("bigint", "int"):
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kinds["n_chars"])))
    return out
