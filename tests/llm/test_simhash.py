import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from keyloom.llm import graph, simhash, similar

SCHEMA = "doc_id long, text string, fp string, node long, component string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, "y") for i, t in rows], SCHEMA)


def brute(rows, shingle=3, radius=2):
    prints = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
        prints[i] = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randrange(40, 200))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(n):
        w = base[i].split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    return [*rows, (5000, None), (5001, ""), (5002, " \t\x0b"), (5003, "One"), (5004, "ONE"), (5005, "two words"), (5006, "Ünder x\u00a0y z")]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_pair_in_radius(radius):
    masks = simhash.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(0)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flips & m for m in masks)


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("pairs", [0, 1, 1000])
def test_large_buckets_give_the_same_components(spark, pairs):
    rng = np.random.default_rng(3)
    centres = rng.integers(-(2**63), 2**63, 6)
    prints = sorted({int(c) ^ simhash._signed(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for c in centres for _ in range(25)})
    distinct = spark.createDataFrame(list(zip(prints, range(len(prints)))), "fp long, node long")
    got = {r.node: r.component for r in graph.components(simhash.links(distinct, 2, pairs).select("a", "b")).collect()}
    parent = list(range(len(prints)))
    for a, b in combinations(range(len(prints)), 2):
        if ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 2:
            x, y = parent[a], parent[b]
            parent = [min(x, y) if p in (x, y) else p for p in parent]
    assert [got.get(i, i) for i in range(len(prints))] == parent


def test_repeated_null_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "q r s t")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (2, 2)], key=str)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 101


def jaccard_classes(rows, least=0.8):
    sets = {i: frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    parent = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if not union or len(sets[a] & sets[b]) >= least * union:
            x, y = parent[a], parent[b]
            parent = {k: min(x, y) if p in (x, y) else p for k, p in parent.items()}
    return {i for i in parent if parent[i] == i}


@pytest.mark.parametrize("few", [24, 2])
def test_one_of_each_class(spark, few, monkeypatch):
    rows = corpus(7, 30)
    rng = random.Random(11)
    hub = rows[0][1].split()
    for i in range(40):  # a large class around one text
        w = list(hub)
        w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((2000 + i, " ".join(w)))
    whole = similar.classes
    monkeypatch.setattr(similar, "classes", lambda *a, **k: whole(*a, few=few, **k))
    kept = similar.one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "node", "component"]
    assert {r.doc_id for r in kept.collect()} == jaccard_classes(rows)


def test_one_of_each_keeps_one_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text), (None, "a b c d e f"), (3, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in similar.one_of_each(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(1, text), (None, "a b c d e f"), (3, None)], key=str)
    assert similar.one_of_each(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [4627, 5641])
def test_one_of_each_verifies_pairs_whose_sketches_differ_much(spark, seed):
    w = [f"{seed}.{i}" for i in range(49)]  # 40 of 50 shingles are common; the sketches differ in 70 places
    rows = [(1, " ".join(w)), (2, " ".join(w[:44] + [f"e{i}" for i in range(5)]))]
    assert jaccard_classes(rows) == {1}
    assert [r.doc_id for r in similar.one_of_each(docs(spark, rows)).collect()] == [1]


def test_fingerprints_of_null_keys_link_others(spark, monkeypatch):
    prints = {"a": 0, "b": 3, "c": 15, "d": 0xFFFF << 40}
    rows = [(5, "a"), (None, "b"), (2, "c"), (None, "d")]
    fake = lambda df, *_, **__: spark.createDataFrame([(i, prints[t]) for i, t in rows], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "with_fingerprints", fake)
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert [got[f"{prints[t]:016x}"] for t in "abcd"] == [2, 2, 2, None]


def near_pairs():
    """Pairs at similarities from 0.80 to 0.85 of texts of 60 to 160 words, and the same from just below 0.8."""
    rng, rows, pairs = random.Random(21), [], []
    for n in range(400):
        size = rng.randrange(60, 160)
        w = [f"{n}.{i}" for i in range(size)]
        least = 0.80 if n % 4 else 0.74
        whole = size - 4
        # an edited tail of e words changes e shingles on either side
        e = next(e for e in range(1, size) if (whole - e) / (whole + e) < least + (0.05 if n % 4 else 0.04))
        while n % 4 and (whole - e) / (whole + e) < 0.8:
            e -= 1
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[: size - e] + [f"e{n}.{i}" for i in range(e)]))]
        pairs.append((whole - e) / (whole + e))
    return rows, pairs


def test_recall_of_pairs_near_the_threshold(spark):
    rows, pairs = near_pairs()
    asked = [n for n, x in enumerate(pairs) if x >= 0.8]
    assert len(asked) == 300 and max(pairs[n] for n in asked) < 0.86
    kept = {r.doc_id for r in similar.one_of_each(docs(spark, rows)).collect()}
    found = sum(2 * n + 1 not in kept for n in asked)
    assert found >= 0.99 * len(asked)  # 0.9996 of them by the bands' probabilities
    assert all({2 * n, 2 * n + 1} <= kept for n in range(len(pairs)) if n not in asked)  # none below
    assert all(2 * n in kept for n in asked)


@pytest.mark.parametrize("few", [24, 4])
def test_recall_on_a_large_planted_group(spark, few, monkeypatch):
    """Some hundred variants of one text, many of them less than 0.8 alike, beside families of their own."""
    rng, rows = random.Random(5), []
    base = [f"b{i}" for i in range(120)]
    for i in range(260):
        w = list(base)
        for k in range(rng.randrange(1, 6)):
            w[rng.randrange(len(w))] = f"x{i}.{k}"
        rows.append((i, " ".join(w)))
    for f in range(20):
        w = [f"f{f}.{i}" for i in range(80)]
        rows += [(1000 + 10 * f + k, " ".join(w[: 78 - k] + [f"g{f}.{k}", "end"])) for k in range(4)]
    whole = similar.classes
    monkeypatch.setattr(similar, "classes", lambda *a, **k: whole(*a, few=few, **k))
    kept = {r.doc_id for r in similar.one_of_each(docs(spark, rows)).collect()}
    want = jaccard_classes(rows)
    gone = {i for i, _ in rows} - want
    assert len(gone - kept) >= 0.99 * len(gone) and want <= kept


def test_parity_never_drops_a_similar_pair():
    rng = np.random.default_rng(13)
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        pool = rng.integers(0, 1 << 63, n + n // 2 + 1, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[int(rng.integers(0, n // 2 + 1)) :])
        x, y = (np.array(similar.parity(s)).view(np.uint64) for s in (a, b))
        flipped = sum(int(v).bit_count() for v in x ^ y)
        assert flipped <= len(np.setxor1d(a, b))
    assert similar.parity(np.zeros(0, dtype=np.uint64)) == [0] * 16
