import random

from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import decontam


def edit_search(p, t):
    prev, best = list(range(len(p) + 1)), (len(p), 0)
    for j, c in enumerate(t):
        cur = [0]
        for i, x in enumerate(p):
            cur.append(min(prev[i] + (x != c), prev[i + 1] + 1, cur[i] + 1))
        prev = cur
        if cur[-1] < best[0]:
            best = (cur[-1], j + 1)
    return best


@given(st.text("ab", min_size=1, max_size=14), st.text("abc", max_size=30))
@settings(deadline=None)
def test_myers_against_dynamic_programming(p, t):
    assert decontam.myers(p, t) == edit_search(p, t)


def items_and_docs(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 9)))
    items = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(25)]
    docs = []
    for _ in range(120):
        text = [word() for _ in range(rng.randrange(5, 60))]
        if rng.random() < 0.6:
            hit = list(rng.choice(items))
            for _ in range(rng.randrange(0, len(hit) // 7)):
                k, what = rng.randrange(len(hit)), rng.random()
                hit[k : k + 1] = [] if what < 0.3 else [rng.choice("abc ")] if what < 0.7 else [hit[k], rng.choice("xyz")]
            text.insert(rng.randrange(len(text)), "".join(hit).upper() if rng.random() < 0.3 else "".join(hit))
        docs.append(" \n".join(text))
    return items, docs


def test_finds_exactly_what_brute_force_finds():
    items, docs = items_and_docs()
    clean = [decontam.normalised(t) for t in items]
    matcher = decontam.Matcher(list(enumerate(clean)), 0.1)
    found = 0
    for d in docs:
        text = decontam.normalised(d)
        got = {i: (distance, a, b) for i, distance, a, b in matcher.find(text)}
        want = {i: edit_search(t, text)[0] for i, t in enumerate(clean)}
        want = {i: e for i, e in want.items() if e <= decontam.budget(len(clean[i]), 0.1)}
        assert {i: g[0] for i, g in got.items()} == want
        for i, (distance, a, b) in got.items():
            assert edit_search(clean[i], text[a:b])[0] == distance
        found += len(want)
    assert found > 20


def test_tables_blocks_and_odd_rows(spark):
    items, docs = items_and_docs(4)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, "  "), (None, items[0]), (92, items[0]), (0, items[0])], "item_id long, text string")
    rows = [*enumerate(docs), (500, None), (501, ""), (502, "long " * 200_000 + items[0]), (0, docs[0]), (None, items[0])]
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, distance int, lang string")
    one = sorted(map(tuple, decontam.matches(df, bench, 0.1).collect()), key=str)
    assert one == sorted(map(tuple, decontam.matches(df, bench, 0.1, block_bytes=2000).collect()), key=str)
    ids = {r[0] for r in one}
    assert {502, None} <= ids and not {500, 501} & ids
    assert {(r[1]) for r in one if r[0] == 502} == {0, 92}
    kept = decontam.without_matches(df, bench, 0.1)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in ids), key=str)
    assert decontam.matches(df.limit(0), bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0
    assert decontam.without_matches(df, bench.limit(0)).count() == len(rows)


def test_items_without_an_id(spark):
    item = "which of these rivers flows through four capital cities"
    bench = spark.createDataFrame([(None, item), (7, "another item of the benchmark, long enough")], "item_id long, text string")
    df = spark.createDataFrame([(1, f"so: {item.upper()}?"), (2, "nothing of the kind")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in decontam.matches(df, bench, 0.08).collect()] == [(1, None, 0)]
    assert [r.doc_id for r in decontam.without_matches(df, bench, 0.08).collect()] == [2]
