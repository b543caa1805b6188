import random

import pytest
from pyspark.sql import functions as F

from keyloom.llm import quality
from keyloom.llm.common import held_out


def rows(n=300):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("etaoinshr", k=rng.randrange(2, 8))) for _ in range(400)]
    out, marks = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(30, 200))
        bad = i % 4 == 0
        out.append((i, " ".join(w + "!!$$" for w in words) if bad else " ".join(words)))
        marks.append((i, 0 if bad else 1))
    return out, marks


def test_held_out_rows(spark):
    given, marks = rows()
    docs = spark.createDataFrame([(*r, 2.5, 1) for r in given], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality.fit(docs, labels, ~held_out())
    scored = quality.with_scores(docs, model).join(labels.withColumnRenamed("quality", "truth"), "doc_id")
    right = scored.where(held_out()).select(F.avg((F.col("predicted") == F.col("truth")).cast("double"))).first()[0]
    assert right > 0.95
    assert scored.columns[:3] == ["doc_id", "text", "quality"]
    assert quality.with_scores(docs.limit(0), model).count() == 0


def test_odd_rows(spark):
    given, marks = rows()
    docs = spark.createDataFrame([*given, (900, None), (901, ""), (None, "x"), (0, given[0][1]), (902, "long text " * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (0, 0), (5, None), (None, 1), (7, 9), (10_000, 1)], "doc_id long, quality int")
    got = quality.with_scores(docs, quality.fit(docs, labels, ~held_out())).collect()
    assert len(got) == len(given) + 5 and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    assert len({r.score for r in got if r.doc_id == 0}) == 1


@pytest.mark.parametrize(("marks", "share"), [([], 0.5), ([(1, 1), (2, 1), (3, 1), (4, 1), (6, 1)], 1.0)])
def test_too_few_labels(spark, marks, share):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    got = quality.with_scores(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert [r.score for r in got] == [share, share]


@pytest.mark.parametrize("n", [1, 3])
def test_few_rows_of_a_class_are_learned_from(spark, n):
    given, marks = rows(60)
    marks = [m for m in marks if m[1]][:20] + [m for m in marks if not m[1]][:n]
    docs, labels = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.with_scores(docs, quality.fit(docs, labels, F.lit(True))).collect()}
    good, bad = ([got[i] for i, _ in given if (i % 4 == 0) == side] for side in (False, True))
    assert sum(good) / len(good) > sum(bad) / len(bad)


def test_tiny_texts_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.with_scores(docs, quality.fit(docs, labels, F.lit(True))).collect())


def test_labels_without_documents_and_copies_do_not_shrink_the_sample(spark):
    given, marks = rows(80)
    copies = [(1000 + k, given[4][1]) for k in range(300)]  # of a bad one
    docs = spark.createDataFrame([*given, *copies], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, *[(1000 + k, 0) for k in range(300)], *[(5000 + k, k % 2) for k in range(500)]], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.with_scores(docs, quality.fit(docs, labels, F.lit(True), sample_rows=60)).collect()}
    good, bad = ([got[i] for i, _ in given if (i % 4 == 0) == side] for side in (False, True))
    assert min(good) > max(bad)


def test_query_against_a_plain_version(spark):
    """The sample, both dictionaries, the features and the curve written out anew, without Spark."""
    import zlib

    import numpy as np
    import zstandard

    given, marks = rows(200)
    docs, labels = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    learned = {i for i, _ in given if zlib.crc32(str(i).encode()) % 5}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    label = dict(marks)
    side = {s: [t.encode() for _, t in sorted((hashes[i], t) for i, t in given if i in learned and label[i] == s)] for s in (0, 1)}
    share = sum(label[i] for i in learned) / len(learned)
    pieces = {s: [t[i : i + 1024] for t in x[::2] for i in range(0, len(t), 1024)] for s, x in side.items()}
    dictionary = {s: zstandard.train_dictionary(max(256, min(112640, sum(map(len, x)) // 4)), x) for s, x in pieces.items()}

    def size(text, s):
        c = zstandard.ZstdCompressor(dict_data=dictionary[s], level=3, write_content_size=False, write_dict_id=False, write_checksum=False)
        return sum(len(c.compress(text[i : i + 1024])) for i in range(0, len(text), 1024))

    def terms(text):
        good, bad = size(text, 1), size(text, 0)
        d, r = (bad - good) / max(good, bad), min(good / len(text), 1.5)
        return [1, d, r, d * r, d * d, r * r]

    x = np.array([terms(t) for s in (0, 1) for t in side[s][1::2]])
    y = np.array([s for s in (0, 1) for _ in side[s][1::2]], dtype=float)
    w = np.array([(share if s else 1 - share) / len(side[s][1::2]) for s in (0, 1) for _ in side[s][1::2]]) * len(y)
    beta = np.zeros(6)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        beta += np.linalg.solve((x.T * (w * p * (1 - p))) @ x + 1e-3 * np.eye(6), x.T @ (w * (y - p)) - 1e-3 * beta)
    want = {i: 1 / (1 + np.exp(-np.array(terms(t.encode())) @ beta)) for i, t in given}
    got = quality.with_scores(docs, quality.fit(docs, labels, ~held_out())).collect()
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-5 and r.predicted == int(r.score >= 0.3)
