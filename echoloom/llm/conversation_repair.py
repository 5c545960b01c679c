"""Cheapest repair of the turn structure of conversations, by generalised LR parsing with edits.

The role grammar is an optional system turn and pairs of user and assistant turns, or nothing. Its LR automaton reads
role initials; before and at each row the parser may also insert a turn, delete the row or give it another role. All
stacks that are alive after a row are kept; equal ones are merged by the smallest (cost, audit), where the audit is the
sequence of edits. Of two edit sequences with equal cost over the same rows none begins with the other (the surplus
would be inserts, which cost), so the least audit of a whole is made of least audits of its parts, and merging is exact.
For the same reason a long conversation may be parsed in blocks, from every stack that can stand at a block's start,
and the blocks' results put together.

1. Rows get their place: a range sort over (conversation, turn, role, text digest), narrow columns only. Ties on all four
   are equal rows; they spread over ranges.
2. The first row of each (conversation, role, text) is a grouped minimum; the rows after it are duplicates.
3. Tasks read ranges in order and parse the run of each conversation. A conversation inside a range is finished; of one
   that crosses ranges each run leaves its costs and audits by (stack before, stack after).
4. Runs meet by conversation, in order, one at a time.
5. Rows and audits meet by conversation, in order, and the repaired rows pass through a digest. A digest over a whole
   conversation is one chain of blocks, so here a conversation is read by one task, row by row, never held.

Defined cases: null is one space in any column, so a null role cannot be kept and a null text is blank; a null
``conv_id`` is a conversation of its own; a role that is empty or begins otherwise than s, u, a cannot be kept; null
turns come first; rows with equal turns are ordered by role and by the digest of their text; repeated rows are
duplicates; a conversation without rows has zeros; an empty table gives none; a long text is hashed as it is.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoloom.llm.batches import column, map_arrow, materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Z is the start, D a dialogue, P pairs, Q one pair; small letters are role initials.
RULES = (("Z", "D"), ("D", ""), ("D", "P"), ("D", "sP"), ("P", "Q"), ("P", "PQ"), ("Q", "ua"))
END = "$"
NEW_ROLES = {"u": "user", "a": "assistant"}
# A pair inserted (two edits) and a system turn deleted make up for any difference between two stacks: what costs more
# than this above the cheapest cannot become the cheapest again.
SLACK = 2 * INSERT + DELETE
_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low bits and the partition above them
# Blanks as a class of characters to trim.
_BLANKS = " \t\n\x0b\x0c\r"

Stack = tuple[int, ...]
Best = dict[Stack, tuple[int, str]]


# ---------------------------------------------------------------- grammar

def _closure(items: Iterable[tuple[int, int]]) -> frozenset:
    found = set(items)
    todo = list(found)
    while todo:
        rule, dot = todo.pop()
        after = RULES[rule][1][dot:dot + 1]
        for i, (left, _) in enumerate(RULES):
            if left == after and (i, 0) not in found:
                found.add((i, 0))
                todo.append((i, 0))
    return frozenset(found)


class Automaton:
    """States of item sets with their shifts, and reductions by the token that may follow."""

    def __init__(self):
        symbols = sorted({c for left, right in RULES for c in left + right})
        states = [_closure([(0, 0)])]
        self.goto: list[dict[str, int]] = []
        for items in states:  # grows while it is read
            moves = {}
            for s in symbols:
                kernel = [(r, d + 1) for r, d in items if RULES[r][1][d:d + 1] == s]
                if kernel:
                    target = _closure(kernel)
                    if target not in states:
                        states.append(target)
                    moves[s] = states.index(target)
            self.goto.append(moves)
        follow = self._follow(symbols)
        self.reduce = [{t: r for r, d in items if d == len(RULES[r][1]) for t in follow[RULES[r][0]]}
                       for items in states]
        # A state with nothing but one finished rule reduces whatever comes next.
        self.always = [next(iter(items))[0] if len(items) == 1 and next(iter(items))[1] == len(RULES[next(
            iter(items))[0]][1]) else None for items in states]

    @staticmethod
    def _follow(symbols: list[str]) -> dict[str, set[str]]:
        nullable = {left for left, right in RULES if not right}
        first = {s: {s} if s.islower() else set() for s in symbols}
        follow: dict[str, set[str]] = {s: set() for s in symbols}
        follow["Z"].add(END)
        for _ in range(len(RULES) ** 2):
            for left, right in RULES:
                for c in right:
                    first[left] |= first[c]
                    if c not in nullable:
                        break
                rest = set(follow[left])
                for c in reversed(right):
                    follow[c] |= rest
                    rest = first[c] | (rest if c in nullable else set())
        return follow

    def _apply(self, stack: Stack, rule: int) -> Stack:
        left, right = RULES[rule]
        under = stack[:len(stack) - len(right)]
        return (*under, self.goto[under[-1]][left])

    def shift(self, stack: Stack, token: str) -> Stack | None:
        """The stack after a token, or None where the grammar does not allow it."""
        while token not in self.goto[stack[-1]]:
            rule = self.reduce[stack[-1]].get(token)
            if rule is None:
                return None
            stack = self._apply(stack, rule)
        stack = (*stack, self.goto[stack[-1]][token])
        while (rule := self.always[stack[-1]]) is not None:
            stack = self._apply(stack, rule)
        return stack

    def accepts(self, stack: Stack) -> bool:
        while (rule := self.reduce[stack[-1]].get(END)) is not None:
            if rule == 0:
                return True
            stack = self._apply(stack, rule)
        return False


AUTOMATON = Automaton()
START: Stack = (0,)


def _reachable() -> dict[Stack, dict[str, Stack]]:
    """Every stack that role initials can lead to, with its moves; the grammar's recursion is on the left, so few."""
    found: dict[Stack, dict[str, Stack]] = {}
    todo = [START]
    while todo:
        stack = todo.pop()
        if stack not in found:
            found[stack] = {t: s for t in "sua" if (s := AUTOMATON.shift(stack, t)) is not None}
            todo += found[stack].values()
    return found


MOVES = _reachable()
STACKS = sorted(MOVES)
ACCEPTED = {s for s in STACKS if AUTOMATON.accepts(s)}


# ---------------------------------------------------------------- repair

def _better(best: Best, stack: Stack, cost: int, audit: str) -> bool:
    if stack in best and best[stack] <= (cost, audit):
        return False
    best[stack] = (cost, audit)
    return True


def _prune(best: Best) -> Best:
    low = min(cost for cost, _ in best.values())
    return {s: v for s, v in best.items() if v[0] <= low + SLACK}


def _insert(best: Best) -> Best:
    """The same stacks and those that inserted turns lead to, cheapest first."""
    out = dict(best)
    todo = [(*v, s) for s, v in best.items()]
    heapq.heapify(todo)
    while todo:
        cost, audit, stack = heapq.heappop(todo)
        if out[stack] == (cost, audit):
            for token in NEW_ROLES:
                after = MOVES[stack].get(token)
                if after and _better(out, after, cost + INSERT, audit + "I"):
                    heapq.heappush(todo, (cost + INSERT, audit + "I", after))
    return out


def _consume(best: Best, code: str) -> Best:
    """The stacks after one row. Codes: s, u, a, o (other role), capitals for truncated text, x for a row to delete."""
    out: Best = {}
    more = TRUNCATED if code.isupper() else 0
    role = code.lower()
    for stack, (cost, audit) in _insert(best).items():
        _better(out, stack, cost + DELETE, audit + "D")
        if role != "x":
            for token, after in MOVES[stack].items():
                if token == role:
                    _better(out, after, cost + KEEP + more, audit + "K")
                if token in NEW_ROLES:
                    _better(out, after, cost + REROLE + more, audit + "R")
    return _prune(out)


def parse(codes: Iterable[str], entry: Stack = START) -> Best:
    """Cheapest (cost, audit) over all rows, by the stack they end in."""
    best: Best = {entry: (0, "")}
    settled: list[str] = []
    for n, code in enumerate(codes):
        best = _consume(best, code)
        if n % 32 == 31:  # what all audits share is decided
            common = os.path.commonprefix([a for _, a in best.values()])
            settled.append(common)
            best = {s: (c, a[len(common):]) for s, (c, a) in best.items()}
    done = "".join(settled)
    return {s: (c, done + a) for s, (c, a) in best.items()}


def finish(best: Best) -> tuple[int, str]:
    """The cheapest whole repair."""
    return min(v for s, v in _insert(best).items() if s in ACCEPTED)


def join_runs(best: Best, run: list[tuple[int, int, int, str]]) -> Best:
    """The stacks after a further run, given as (stack before, stack after, cost, audit) by number."""
    out: Best = {}
    for before, after, cost, audit in run:
        if (held := best.get(STACKS[before])) is not None:
            _better(out, STACKS[after], held[0] + cost, held[1] + audit)
    return _prune(out)


@lru_cache(maxsize=1 << 15)
def _repair_short(codes: str) -> tuple[int, str]:
    return finish(parse(codes))


def repair(codes: str) -> tuple[int, str]:
    """(cost, audit) of a conversation of these rows."""
    return _repair_short(codes) if len(codes) <= 64 else finish(parse(codes))


# ---------------------------------------------------------------- rows

def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that the checksum of conversation and turn draws for each row."""
    rows = conversation_rows(conversations)
    name = F.concat(*(F.coalesce(c, F.lit(" ")) for c in (F.col("conv_id").cast("string"), F.lit(":"),
                                                          F.col("turn").cast("string"))))
    drawn = F.crc32(name.cast("binary")) % 20
    return (
        rows.withColumn("_drawn", drawn).where("_drawn != 0")
        .withColumn("_copy", F.explode(F.when(F.col("_drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))))
        .select("conv_id", "turn", F.when(F.col("_drawn") == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(F.col("_drawn") == 1, "").when(F.col("_drawn") == 2, F.translate("text", ".!?", ""))
                .otherwise(F.col("text")).alias("text"))
    )


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` alone, null role and text as one space."""
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def _order() -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "digest")]


def place_rows(rows: DataFrame) -> DataFrame:
    """Rows without their texts, in global order: ``at`` and, above its low bits, ``part``, the range a row is in."""
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    narrow = rows.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), (end == "").alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("tie"))
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_order(), F.col("tie")]
    return materialize(
        narrow.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("tie")
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", _ROW_BITS).cast("int")), "turns")


def code_rows(placed: DataFrame) -> DataFrame:
    """``conv_id, turn, part, at, initial, fault`` per row, ``fault`` one of blank, duplicate, truncated, or null."""
    firsts = placed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"))
    return placed.join(firsts.select("first"), F.col("at") == F.col("first"), "left").select(
        "conv_id", "turn", "part", "at", F.left("role", F.lit(1)).alias("initial"),
        F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
        .alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated")
_RUN = ("conv_id long, part int, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
        "least long, most long, turns long, paths array<struct<before:int,after:int,cost:long,audit:string>>, "
        "cost long, audit string")
_LEGAL = {"su", "ua", "au"}
_CODE = {"s": "s", "u": "u", "a": "a"}
_PATHS = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()),
                             ("audit", pa.string())]))
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


class _Run:
    """The rows of one conversation in one range, as they are read."""

    def __init__(self, conv_id, part, edge):
        self.conv_id, self.part, self.edge = conv_id, part, edge
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.codes: list[str] = []
        self.illegal = self.turns = 0
        self.head = self.tail = self.least = self.most = None

    def add(self, turn, initial, fault):
        if fault:
            self.counts[fault] += 1
        code = "x" if fault in ("blank", "duplicate") else _CODE.get(initial, "o")
        self.codes.append(code.upper() if fault == "truncated" else code)
        if self.tail is None:
            self.head = initial
        elif self.tail + initial not in _LEGAL:
            self.illegal += 1
        self.tail = initial
        if turn is not None and turn != self.most:  # rows come by turn
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.most = turn

    def row(self, last: bool) -> tuple:
        """What the run leaves; ``last`` if it ends its range, where the conversation may go on elsewhere."""
        codes = "".join(self.codes)
        paths = cost = audit = None
        if self.edge or last:
            paths = [{"before": i, "after": STACKS.index(after), "cost": c, "audit": a}
                     for i, before in enumerate(STACKS) for after, (c, a) in parse(codes, before).items()]
        else:
            cost, audit = repair(codes)
        return (self.conv_id, self.part, *self.counts.values(), self.illegal, self.head, self.tail, self.least,
                self.most, self.turns, paths, cost, audit)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [(name, _PATHS if name == "paths" else _TYPES[kind])
              for name, kind in (f.split(" ", 1) for f in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _flush(rows: Iterable[tuple], schema: str, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def parse_runs(coded: DataFrame) -> DataFrame:
    """One row per conversation and range: counts, and the repair or its paths from stack to stack."""
    def runs(batches):
        run: _Run | None = None
        for batch in batches:
            for conv_id, part, turn, initial, fault in zip(*(column(batch, c).to_pylist() for c in (
                    "conv_id", "part", "turn", "initial", "fault"))):
                if run is None or run.part != part or run.conv_id != conv_id:
                    if run:
                        yield run.row(run.part != part)
                    run = _Run(conv_id, part, run is None or run.part != part)
                run.add(turn, initial, fault)
        if run:
            yield run.row(True)

    tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(coded.repartition(tasks, "part").sortWithinPartitions("at"),
                     lambda batches: _flush(runs(batches), _RUN), _RUN)


_REPAIR = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def join_conversations(runs: DataFrame) -> DataFrame:
    """One row per conversation, its runs put together in order."""
    def whole(batches):
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                if held and held["conv_id"] == r["conv_id"]:
                    _extend(held, r)
                else:
                    if held:
                        yield _result(held)
                    held = r
                    if r["paths"] is not None:
                        held["best"] = join_runs({START: (0, "")}, _paths(r))
                        held["done"] = []
        if held:
            yield _result(held)

    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(runs.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "part"),
                     lambda batches: _flush(whole(batches), _REPAIR), _REPAIR)


def _paths(row: dict) -> list[tuple]:
    return [(p["before"], p["after"], p["cost"], p["audit"]) for p in row["paths"]]


def _extend(held: dict, r: dict) -> None:
    for c in _COUNTS:
        held[c] += r[c]
    held["illegal"] += r["illegal"] + (held["tail"] + r["head"] not in _LEGAL)
    held["tail"] = r["tail"]
    if r["turns"]:
        held["turns"] += r["turns"] - (r["least"] == held["most"])
        held["least"] = r["least"] if held["least"] is None else held["least"]
        held["most"] = r["most"]
    best = join_runs(held["best"], _paths(r))
    common = os.path.commonprefix([a for _, a in best.values()])
    held["done"].append(common)
    held["best"] = {s: (c, a[len(common):]) for s, (c, a) in best.items()}


def _result(held: dict) -> tuple:
    cost, audit = held["cost"], held["audit"]
    if held["paths"] is not None:
        cost, audit = finish(held["best"])
        audit = "".join(held["done"]) + audit
    gaps = held["most"] - held["least"] + 1 - held["turns"] if held["turns"] else 0
    return (held["conv_id"], gaps, *(held[c] for c in _COUNTS), held["illegal"], cost, audit)


class Rewriter:
    """Applies an audit to rows as they come and gives the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.turns = audit, 0, 0

    def _new_role(self) -> str:
        self.turns += 1
        return NEW_ROLES["u" if self.turns % 2 else "a"]

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            yield self._new_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.turns += role[:1] != "s"
            yield role, text
        elif edit == "R":
            yield self._new_role(), text

    def rest(self) -> Iterator[tuple[str, str]]:
        return self._inserted()


def _stream(rows: DataFrame, repairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Of each conversation its id, then its repair, then its rows, in one ordered run of a task."""
    names = [c.split()[0] for c in _REPAIR.split(", ")]
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _REPAIR.split(", ")) if n != "conv_id"]
    texts = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text",
                        F.md5(F.col("text").cast("binary")).alias("digest"), *nothing)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"),
                                                      ("digest", "string"))]
    heads = repairs.select("conv_id", F.lit(1).alias("kind"), *empty, *names[1:])
    known = ids.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), *empty, *nothing)
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.unionByName(heads).unionByName(texts).repartition(tasks, "conv_id").sortWithinPartitions(
        "conv_id", "kind", *_order()[1:])


_DIGESTS = f"{_REPAIR}, repaired_sha256 string"
_TURNS = "conv_id long, place long, role string, text string"


def _repair_rows(conversations: DataFrame) -> DataFrame:
    rows = conversation_rows(conversations)
    return join_conversations(parse_runs(code_rows(place_rows(rows))))


def repair_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place, role, text``."""
    rows = conversation_rows(conversations)

    def run(batches):
        def turns():
            writer, conv, place = None, None, 0
            for batch in batches:
                for conv_id, kind, role, text, audit in zip(*(column(batch, c).to_pylist() for c in (
                        "conv_id", "kind", "role", "text", "audit"))):
                    if kind == 0:
                        for out in writer.rest() if writer else ():
                            yield conv, place, *out
                            place += 1
                        writer, conv, place = None, conv_id, 0
                    elif kind == 1:
                        writer = Rewriter(audit)
                    else:
                        for out in writer.row(role, text):
                            yield conv, place, *out
                            place += 1
            for out in writer.rest() if writer else ():
                yield conv, place, *out
                place += 1

        return _flush(turns(), _TURNS)

    return map_arrow(_stream(rows, _repair_rows(conversations), rows), run, _TURNS)


def repair_conversations(conversations: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """Faults, cheapest repair and digest of the repaired rows, per conversation of ``originals`` (or of the rows)."""
    rows = conversation_rows(conversations)
    ids = rows if originals is None else conversation_rows(originals)

    def run(batches):
        def digests():
            held: list | None = None
            for batch in batches:
                for kind, role, text, *repair in zip(*(column(batch, c).to_pylist() for c in (
                        "kind", "role", "text", *(f.split()[0] for f in _REPAIR.split(", "))))):
                    if kind == 0:
                        if held:
                            yield close(held)
                        held = [(repair[0], 0, 0, 0, 0, 0, 0, ""), None, hashlib.sha256(), 0]
                    elif kind == 1:
                        held[:2] = tuple(repair), Rewriter(repair[-1])
                    else:
                        update(held, held[1].row(role, text))
            if held:
                yield close(held)

        def update(held, out):
            for role, text in out:
                held[2].update(("\n" * bool(held[3]) + f"{role}:{text}").encode())
                held[3] = 1

        def close(held):
            if held[1]:
                update(held, held[1].rest())
            return *held[0], held[2].hexdigest()

        return _flush(digests(), _DIGESTS)

    return map_arrow(_stream(rows, _repair_rows(conversations), ids), run, _DIGESTS)
