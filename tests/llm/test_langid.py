import random

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import langid
from keyloom.llm.common import held_out

WORDS = {"en": "the and was here for of time with dog house".split(), "de": "der und das nicht mehr hier ein die zeit haus".split(), "ru": "привет мир и все люди дом время это был".split()}


def text(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n))


def test_held_out_rows_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 20), lang, 0.0) for i, lang in enumerate(rng.choices(list(WORDS), k=200))]
    odd = [(900, None, "en", 0.0), (901, "", None, 0.0), (902, "12 3! -", "de", 0.0), (905, "\u0301 \u0308\u0301", None, 0.0), (None, "the dog", "en", 0.0), (903, "東京は", None, 0.0), (0, rows[0][1], rows[0][2], 0.0), (904, "der hund " * 100_000, None, 0.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    model = langid.fit(df, ~held_out())
    got = langid.with_languages(df, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "spans"]
    seen = {r.doc_id: r for r in got.collect()}
    assert all(seen[i].lang_pred == lang for i, _, lang, _ in rows)
    assert [seen[i].lang_pred for i in (900, 901, 902, 905, 904)] == ["und", "und", "und", "und", "de"]
    assert seen[900].score == 0 and seen[903].lang_pred in WORDS and all(0 <= r.score <= 1 for r in seen.values())
    assert langid.with_languages(df.limit(0), model).count() == 0
    nothing = langid.fit(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.with_languages(df, nothing).collect()} == {"und"}


def test_spans_of_mixed_text():
    rng = random.Random(2)
    model = langid.train([(lang, text(rng, lang, 40)) for lang in WORDS for _ in range(5)])
    a, b, c = text(rng, "en", 12), text(rng, "de", 9), text(rng, "ru", 15)
    _, _, spans = langid.Labeller(model, 4.0).label([f"{a}. {b} -- {c}!", None])
    assert [(s["lang"], s["start"], s["end"]) for s in spans[0]] == [("en", 0, len(a)), ("de", len(a) + 2, len(a) + 2 + len(b)), ("ru", len(a) + len(b) + 6, len(a) + len(b) + 6 + len(c))]
    assert spans[1] == []


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    labeller = langid.Labeller(langid.train([("a", "x"), ("b", "y"), ("c", "z")]), 1.5)
    sizes = [1, 5, 3, 7, 2]
    doc = np.repeat(np.arange(5), sizes)
    table = rng.normal(size=(len(doc), 3)) * 2
    got = labeller._viterbi(table, doc)
    from itertools import product

    for d in range(5):
        t = table[doc == d]
        score = lambda p: sum(t[i, s] for i, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        assert np.isclose(score(got[doc == d]), max(map(score, product(range(3), repeat=len(t)))))


def test_every_language_is_learned(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, text(rng, "en", 20), "en") for i in range(20)] + [(50, "1 2 " * 50_000 + text(rng, "ru", 20_000), "ru"), (51, "", "ru"), (52, text(rng, "de", 20), "de")]
    rows += [(100 + i, f"{chr(0x0531 + i % 30)}{chr(0x0561 + i // 30)} " * 9, f"x{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert set(model.languages) == {r[2] for r in rows}
    assert langid.Labeller(model).label([text(rng, "ru", 9)])[0] == ["ru"]


def test_scans_do_not_grow_with_languages_and_a_repeated_key_is_one_row(spark):
    rng = random.Random(6)
    rows = [(i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} ab{i} " * 6, f"l{i:03d}") for i in range(600)]
    jobs = []
    for n in (2, 600):
        df = spark.createDataFrame(rows[:n], "doc_id long, text string, lang string").union(spark.range(1000).select(F.col("id") + 1000, F.lit(text(rng, "de", 9)), F.lit("de")))
        spark.sparkContext.setJobGroup(f"fit{n}", "")
        model = langid.fit(df, F.lit(True))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit{n}")))
        spark.sparkContext.setJobGroup("none", "")
        assert len(model.languages) == n + 1
    assert jobs[1] <= jobs[0] + 2
    assert model.weights.nbytes <= langid.MODEL_BYTES
    assert langid.Labeller(model).label([rows[77][1], rows[500][1]])[0] == ["l077", "l500"]
    seen = {}
    monkey = langid.train
    try:
        langid.train = lambda rows: seen.setdefault("rows", rows) and monkey(rows)
        repeated = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("der hund "), (F.col("id") % 50).cast("string")).alias("text"), F.lit("de").alias("lang"))
        langid.fit(repeated.union(spark.createDataFrame([(i, f"the dog {i}", "en") for i in range(2000)], "doc_id long, text string, lang string")), F.lit(True))
    finally:
        langid.train = monkey
    assert sum(lang == "de" for lang, _ in seen["rows"]) == 1 and 1000 < sum(lang == "en" for lang, _ in seen["rows"]) <= 1500


def test_scores_and_labels_against_a_plain_version():
    """Word by word and text by text: every n-gram of every language looked up by itself, and the best of all label sequences."""
    from itertools import product

    rng = random.Random(7)
    model = langid.train([(lang, text(rng, lang, 30)) for lang in WORDS for _ in range(4)])
    labeller = langid.Labeller(model, 3.0)
    for _ in range(12):
        given = " ".join(rng.choice(WORDS[rng.choice(list(WORDS))]) for _ in range(rng.randrange(1, 8)))
        words = langid.words_of([given], model.bits)
        ends = [*words.starts[1:], len(words.hashes[0])]
        plain = []
        for k, (a, b) in enumerate(zip(words.starts, ends)):
            sums = [sum(float(model.weights[h[i], n]) for h in words.hashes for i in range(a, b)) * 0.5 for n in range(3)]
            plain.append([x if model.allowed[words.script[k], n] else -np.inf for n, x in enumerate(sums)])
        assert np.allclose(labeller.word_scores(words), plain, atol=1e-4)
        score = lambda p: sum(plain[i][s] for i, s in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(product(range(3), repeat=len(plain)), key=score)
        letters = [sum(int(words.last[i] - words.first[i]) for i, s in enumerate(best) if s == n) for n in range(3)]
        langs, scores, spans = labeller.label([given])
        assert langs[0] == model.languages[letters.index(max(letters))] and 0 <= scores[0] <= 1
        assert [given[s["start"] : s["end"]] for s in spans[0]] and all(s["lang"] in model.languages for s in spans[0])
        for s in spans[0]:  # a script that a language does not use never gets its label
            assert not (s["lang"] == "ru" and any("a" <= c <= "z" for c in given[s["start"] : s["end"]]))
