import random

import numpy as np
import pytest
import xxhash

from echoloom.llm import components, shingle_links, simhash as ops
from tests.llm.conftest import AWKWARD


def brute_words(text):
    words = []
    for part in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace(
            "\x0c", " ").split(" "):
        words += ["".join(c.lower() if "A" <= c <= "Z" else c for c in part)] if part else []
    return words


def brute_similar(one, two):
    """Whether two texts share four fifths of their distinct five-word shingles."""
    a, b = ({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in map(brute_words, (one, two)))
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def brute_print(text):
    words = brute_words(text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, texts=None):
    """Component leader per row of (doc_id, fingerprint); similar texts are linked too where there are any."""
    leader = list(range(len(prints)))

    def find(i):
        while leader[i] != i:
            i = leader[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4 or texts and brute_similar(texts[i], texts[j]):
                leader[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(prints):
        ids.setdefault(find(i), []).append(doc)
    lead = {r: min((d for d in docs if d is not None), default=None) for r, docs in ids.items()}
    return [lead[find(i)] for i in range(len(prints))], list(lead.values())


def test_documents(docs):
    rng = random.Random(1)
    base = [rng.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=60) for _ in range(12)]
    rows = list(AWKWARD)
    for i in range(120):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = "Omega"
        rows.append((1000 - i, " ".join(words)))
    got = ops.near_copies(docs(rows)).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_groups(prints)[0])), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    kept = ops.keep_first(docs(rows))
    assert kept.columns == docs(rows).columns
    leads = brute_groups(prints, [t for _, t in rows])[1]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(leads, key=str)


def test_copies_with_words_changed(docs):
    """Copies beyond the distance of fingerprints go, a star of copies of one text among them; other texts stay."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]

    def changed(text, n):
        new = list(text)
        for at in rng.sample(range(len(text)), n):
            new[at] = rng.choice(words)
        return new

    rows, texts = [], [rng.choices(words, k=rng.randrange(60, 300)) for _ in range(40)]
    for i, text in enumerate(texts):
        rows += [(i, " ".join(text)), (100 + i, " ".join(changed(text, len(text) * (i % 5) // 100)))]
    star = rng.choices(words, k=200)
    rows += [(500, " ".join(star).upper())] + [(501 + i, " ".join(changed(star, 4))) for i in range(150)]
    rng.shuffle(rows)
    want = brute_groups([(i, brute_print(t)) for i, t in rows], [t for _, t in rows])[1]
    assert 41 < len(want) < 80
    assert sorted(r.doc_id for r in ops.keep_first(docs(rows)).collect()) == sorted(want)


@pytest.mark.parametrize("shared,own", [(110, 30), (116, 26), (130, 20)])
def test_template_family_stays(docs, shared, own):
    """Texts around one template, with near fingerprints but a similarity of 0.63 to 0.76, are no copies."""
    rng = random.Random(shared)
    template = [f"t{i}" for i in range(shared)]
    rows = [(i, " ".join(template + [f"w{rng.randrange(10 ** 6)}" for _ in range(own)])) for i in range(300)]
    prints = [(i, brute_print(t)) for i, t in rows]
    assert len(brute_groups(prints)[1]) < 300 and not any(brute_similar(rows[0][1], t) for _, t in rows[1:])
    assert sorted(r.doc_id for r in ops.keep_first(docs(rows + [(900, rows[7][1])])).collect()) == list(range(300))


def family_and_revisions(rng):
    """Texts around a template, near copies of some of them, and chains of texts that each revise the last one."""
    words = [f"w{i}" for i in range(10 ** 5)]
    template = rng.choices(words, k=122)
    texts = [template + rng.choices(words, k=22) for _ in range(240)]
    texts += [t[:130] + rng.choices(words, k=10) + t[140:] for t in texts[:40]]
    for _ in range(12):
        text = rng.choices(words, k=154)
        for step in range(8):
            texts.append(text)
            text = text[:step * 15] + rng.choices(words, k=11) + text[step * 15 + 11:]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("key_rows", [2048, 32])
def test_components_equal_brute_force(spark, key_rows):
    """All similar pairs are linked, also where no band proposes any, in blocks too."""
    rows = family_and_revisions(random.Random(key_rows))
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    near = [(i, j) for i in range(len(rows)) for j in range(i)
            if 5 * len(both := sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]) - len(both))]
    leader = list(range(len(rows)))
    for i, j in near * 8:
        leader[i] = leader[j] = min(leader[i], leader[j])
    texts = spark.createDataFrame(rows, "digest long, text string")
    none = spark.createDataFrame([], "a long, b long")
    with pytest.MonkeyPatch.context() as patch:
        # Bands that propose nothing: what is left to them must not matter.
        patch.setattr(shingle_links, "_candidates", lambda bands: none)
        got = {r.node: r.component for r in shingle_links.shingle_components(texts, none, key_rows).collect()}
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(leader[i], []).append(d)
    assert got == {d: min(g) for g in groups.values() if len(g) > 1 for d in g}
    assert len(got) == 80 + 96


def test_near_fingerprints_are_judged_by_fingerprints_alone(spark, docs, monkeypatch):
    """Similar texts within the distance go because their fingerprints meet, others because their shingles do."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        text = rng.choices(words, k=rng.randrange(80, 400))
        copy = list(text)
        for at in rng.sample(range(len(text)), 1 + len(text) // 80):
            copy[at] = rng.choice(words)
        rows += [(i, " ".join(text)), (100 + i, " ".join(copy))]
    apart = [(brute_print(a) ^ brute_print(b)).bit_count() for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    similar = [brute_similar(a, b) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    near = [i for i in range(60) if similar[i] and 0 < apart[i] <= 4]
    assert len(near) > 5 and any(s and d > 4 for s, d in zip(similar, apart))
    stay = list(range(60)) + [100 + i for i in range(60) if not similar[i]]
    assert sorted(r.doc_id for r in ops.keep_first(docs(rows)).collect()) == stay
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(ops, "near_links", lambda *_: none)
    assert sorted(r.doc_id for r in ops.keep_first(docs(rows)).collect()) == sorted(stay + [100 + i for i in near])


@pytest.mark.parametrize("key_rows", [2048, 40])
def test_near_pairs_in_blocks(spark, key_rows):
    """Families of near fingerprints, cut into blocks in the second case: all pairs of different components."""
    rows = family_and_revisions(random.Random(5))
    texts = spark.createDataFrame(rows, "digest long, text string")
    held = texts.sparkSession.createDataFrame(shingle_links.profiles(texts, ops.fingerprint).collect())
    families = components.connected(ops.near_links(held.select("print").distinct()))
    prints = [(d, brute_print(t)) for d, t in rows]
    near = {tuple(sorted((d, e))) for i, (d, p) in enumerate(prints) for e, q in prints[:i] if (p ^ q).bit_count() <= 4}
    texts_of = dict(rows)
    want = {(a, b) for a, b in near if brute_similar(texts_of[a], texts_of[b])}
    none = spark.createDataFrame([], "node long, component long")
    got = {tuple(r) for r in ops._near_pairs(held, families, none, key_rows).collect()}
    assert want and want <= got <= near
    spanning = ops._near_pairs(held, families, None, key_rows)
    assert components.connected(spanning).exceptAll(components.connected(spark.createDataFrame(
        sorted(got), "a long, b long"))).isEmpty() and spanning.count() <= len(got)


def test_similar_sets_keep_parities_and_prefixes():
    """At the least similarity sets are within the parity bound and meet in their prefixes, whatever shingle is common."""
    rng = random.Random(3)
    for n in [1, 4, 9, 45, 450, 4500] * 5:
        both, one = (np.array([rng.getrandbits(64) for _ in range(k)], np.uint64) for k in (4 * n, n))
        own = rng.randrange(n + 1)
        a, b = (np.sort(np.append(both, x)) for x in (one[:own], one[own:]))
        assert shingle_links.similar(a, b)
        x, y = (np.frombuffer(shingle_links.parities(s), np.uint8) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) * 9 <= len(a) + len(b)
        common = np.sort(both[:n])
        counts = np.array([rng.randrange(8, 99) for _ in common])
        assert len(np.intersect1d(shingle_links.prefix(a, common, counts), shingle_links.prefix(b, common, counts)))


def test_shingle_sets():
    assert not len(shingle_links.shingles(None)) and not len(shingle_links.shingles(" \t "))
    assert len(shingle_links.shingles("One two")) == 1
    assert (shingle_links.shingles("one TWO") == shingle_links.shingles(" One\ttwo\n")).all()
    assert len(shingle_links.shingles("a b c d e " * 900)) == 5


@pytest.mark.parametrize("key_rows", [2048, 16])
def test_random_neighbourhoods(spark, key_rows):
    """Dense balls of fingerprints, whose keys outgrow the limit in the second case."""
    rng = random.Random(key_rows)
    prints = set()
    for _ in range(6):
        centre, soft = rng.getrandbits(64), rng.sample(range(64), 9)
        for _ in range(60):
            p = centre
            for b in rng.sample(soft, rng.randrange(6)) + rng.sample(range(64), rng.randrange(4)):
                p ^= 1 << b
            prints.add(p)
    rows = list(enumerate(sorted(prints, key=lambda p: p * 7919 % 2 ** 61)))
    table = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in rows], "doc_id long, print long")
    got = {r.print % 2 ** 64: r.component_id for r in ops.groups(table, key_rows).collect()}
    assert [got[p] for _, p in rows] == brute_groups(rows)[0]


def test_every_near_pair_keeps_a_chain():
    rng = random.Random(9)
    for _ in range(300):
        x = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        held = [bool(ops.chain_holds(np.array([x], np.uint64), np.array([s]))[0]) for s in range(5)]
        assert any(held)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(300, 340)] + [(7, x) for x in range(50, 90)] + [(1, 1), (5, 3), (3, 5)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300, 341), 300), **dict.fromkeys([7, *range(50, 90)], 7), 3: 3, 5: 3}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(docs):
    empty = docs([(1, "x")]).where("false")
    assert ops.near_copies(empty).count() == 0 and ops.keep_first(empty).count() == 0
