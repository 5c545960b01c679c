"""Repairs against every edit sequence, and whole tables against a loop over conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from echoloom.llm import conversation_repair as ops

GRAMMAR = re.compile(r"(s?(ua)+)?")


def brute_repair(codes):
    """The least (cost, audit) over all edit sequences that reach each of the shortest target role strings."""
    n = len(codes)
    targets = ["", *(s + "ua" * k for k in range(1, n // 2 + 3) for s in ("", "s"))]

    def scripts(at, left, cost, audit, limit):
        if cost > limit:
            return
        if at == n and not left:
            yield cost, audit
            return
        if left and left[0] != "s":
            yield from scripts(at, left[1:], cost + 2, audit + "I", limit)
        if at < n:
            code = codes[at]
            yield from scripts(at + 1, left, cost + 3, audit + "D", limit)
            if left and code != "x":
                if code.lower() == left[0]:
                    yield from scripts(at + 1, left[1:], cost + code.isupper(), audit + "K", limit)
                if left[0] != "s":
                    yield from scripts(at + 1, left[1:], cost + 2 + code.isupper(), audit + "R", limit)

    return min(s for t in targets for s in scripts(0, t, 0, "", 3 * n))


def test_every_short_conversation():
    for n in range(4):
        for codes in itertools.product("suaoSUAx", repeat=n):
            assert ops.repair("".join(codes)) == brute_repair(codes), codes


def test_longer_conversations_and_blocks():
    rng = random.Random(6)
    for _ in range(60):
        codes = "".join(rng.choices("suaoSUAOx", (1, 5, 5, 1, 1, 2, 2, 1, 2), k=rng.randrange(4, 7)))
        assert ops.repair(codes) == brute_repair(codes), codes
    for _ in range(40):
        codes = "".join(rng.choices("suaoSUAOx", (1, 9, 9, 1, 1, 2, 2, 1, 2), k=rng.randrange(100, 300)))
        whole, at, best = ops.finish(ops.parse(codes)), 0, {ops.START: (0, "")}
        while at < len(codes):
            size = rng.randrange(1, 90)
            run = [(i, ops.STACKS.index(s), c, a) for i, before in enumerate(ops.STACKS)
                   for s, (c, a) in ops.parse(codes[at:at + size], before).items()]
            best, at = ops.join_runs(best, run), at + size
        assert ops.finish(best) == whole


def test_the_automaton_reads_the_grammar():
    for n in range(6):
        for word in itertools.product("sua", repeat=n):
            stack = ops.START
            for token in word:
                stack = stack and ops.MOVES[stack].get(token)
            assert bool(stack and stack in ops.ACCEPTED) == bool(GRAMMAR.fullmatch("".join(word))), word


def brute(rows):
    """The query by its contract, one conversation after the other."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs[conv]
        if drawn == 0:
            continue
        if drawn == 1:
            text = ""
        if drawn == 2:
            text = re.sub("[.!?]", "", text)
        if drawn == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if drawn == 3 else 1)
    out = Counter()
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        codes, counts, seen = [], Counter(), set()
        for turn, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not solid else "duplicate" if (role, text) in seen
                     else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
            counts[fault] += 1
            code = "x" if fault in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes.append(code.upper() if fault == "truncated" else code)
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit = ops.repair("".join(codes)) if kept else (0, "")
        done, at, place = [], 0, 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[at][1:]
            at += edit != "I"
            if edit == "D":
                continue
            if edit != "K":
                role = ("user", "assistant")[place % 2]
            place += role[:1] != "s"
            done.append(f"{role}:{text}")
        assert GRAMMAR.fullmatch("".join(d[0] for d in done))
        out[conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest()] += 1
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture
def talks(spark):
    def make(rows):
        return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                     "conv_id long, turn long, role string, text string, at int, kind string")
    return make


def run(frame):
    got = ops.repair_conversations(ops.damage(frame), frame).collect()
    return Counter(tuple(r[c] for c in COLUMNS) for r in got)


def random_rows(rng, convs, turns):
    texts = ["Good. ", "Why?", "cut off", " \n", "", "Fine!\n", None, "é?", "x" * 50000 + ".", "a\nb."]
    return [(c, rng.choice([t, t, t, t, None, t + 1]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]),
             rng.choice(texts) if rng.random() < 0.4 else f"Text {c} {t}.")
            for c in convs for t in range(rng.randrange(turns))]


def test_tables_equal_brute_force(talks):
    rng = random.Random(8)
    rows = random_rows(rng, [*range(120), None, -5, 2 ** 62], 9) + random_rows(rng, [7000], 400)
    rows += rows[:40] + [(900 + i, 0, "user", "Same first turn of all.") for i in range(50)]
    rng.shuffle(rows)
    assert run(talks(rows)) == brute(rows)


def test_one_conversation_with_most_rows(talks):
    """It crosses every range, in which runs of equal rows are cut too."""
    rng = random.Random(12)
    rows = random_rows(rng, [1], 2) + [(5, t // 3, rng.choice(["user", "assistant", "system"]), f"T {rng.randrange(900)}.")
                                       for t in range(3000)] + [(5, 77, "user", "Again.")] * 500
    assert run(talks(rows)) == brute(rows)


def test_conversations_without_rows_and_empty_table(talks):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None)]
    assert run(talks(rows)) == brute(rows)
    assert ops.repair_conversations(talks(rows).where("false")).count() == 0


def test_repaired_turns_have_the_digest_of_the_report(talks):
    frame = talks(random_rows(random.Random(2), range(40), 8))
    turns = defaultdict(list)
    for r in ops.repair_turns(frame).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    report = ops.repair_conversations(frame).collect()
    assert report and all(r.repaired_sha256 == hashlib.sha256("\n".join(turns[r.conv_id]).encode()).hexdigest()
                          for r in report)
