import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import substrings as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    passage = lambda n: " ".join(word() for _ in range(n))
    shared = [passage(n) for n in (30, 60, 90, 200)]
    texts = []
    for _ in range(60):
        parts = [passage(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 5))]
        for s in rng.sample(shared, rng.randrange(0, 3)):
            cut = rng.randrange(len(s) // 3)
            parts.insert(rng.randrange(len(parts) + 1), s[cut:] if rng.random() < 0.5 else s)
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], "z" * 150, "z" * 700, "ab" * 400, shared[2] + shared[2], None, "", "x" * 199, "y" * 200, "y" * 200]
    return texts


@pytest.mark.parametrize(("seed", "many"), [(1, 900), (2, 1), (3, 3)])
def test_against_brute_force(spark, seed, many, monkeypatch):
    whole = S.repeated_spans
    monkeypatch.setattr(S, "repeated_spans", lambda d, t, n: whole(d, t, n, many))
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion_against_sorting(seed):
    rng = random.Random(seed)
    segments = [bytes(rng.choices(b"ab", k=rng.randrange(5, 120))) for _ in range(30)]
    length = 9
    seen = Counter(s[i : i + length] for s in segments for i in range(len(s) - length + 1))
    want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in segments]
    assert [x.tolist() for x in S.repeated_starts(segments, length)] == want


def test_anchors_of_long_texts_cover_all_windows():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 101, 30_000).astype(np.uint8).tobytes()
    for stretch in (1 << 22, 1000):
        a, place, first, last = S.anchors(text, stretch=stretch)
        covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)])
        assert covered.tolist() == list(range(len(text) - 199))
        assert ((place >= first) & (place + S.GRAM <= first + 200)).all() and ((place >= last) & (place + S.GRAM <= last + 200)).all()


def test_repeated_and_null_keys_and_no_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=500))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "short"), (2, "short")], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in S.without_repeats(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 500), (1, 500), (None, 500), (2, 0), (2, 0)], key=str)
    assert S.without_repeats(df.limit(0)).count() == 0


def test_stage_keeps_columns_and_whole_characters(spark):
    p = "é" * 150  # 300 bytes
    rows = [(1, "axx" + p + " end", 5), (2, "b" + p + "!", 6), (3, p, 7), (4, None, 0), (5, "clean", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.deduplicated(df).collect()}
    assert got == {1: ("axx end", 7), 2: ("b!", 2), 4: (None, 0), 5: ("clean", 5)}


def test_hot_anchors_are_dealt_to_all_tasks(spark):
    from keyloom.llm.common import spread, stored

    rows = [(k if k < 3 else 9, i, i % 7) for i in range(9000) for k in (i % 5,)]
    large = stored(spark.createDataFrame(rows, "a long, i long, b long"), "large")
    small = stored(large.groupBy("a").count().where("a <> 1").withColumn("x", F.col("a") * 2), "small")
    got = spread(large, small, ["a"], "count", 9000)
    want = large.join(small.drop("count"), ["a"])
    assert sorted(map(tuple, got.select("a", "i", "b", "x").collect())) == sorted(map(tuple, want.select("a", "i", "b", "x").collect()))
    passage = "".join(random.Random(1).choices("abcdefgh ", k=260))
    texts = [f"{i:06d} {passage}" for i in range(2500)] + ["alone " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.without_repeats(df).collect()}
    assert [found[i] for i in range(len(texts))] == brute(texts, 200)
