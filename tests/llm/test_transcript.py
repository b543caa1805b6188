import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import transcript as tr


def random_model(seed):
    rng = np.random.default_rng(seed)
    return tr.Model(*(np.log(rng.dirichlet(np.ones(k), size=s)) for k, s in ((tr.STATES, ()), (tr.STATES, tr.STATES), (tr.SYMBOLS, tr.STATES))))


@pytest.mark.parametrize("seed", range(5))
def test_blocks_give_the_path_of_the_whole(seed):
    m, rng = random_model(seed), np.random.default_rng(seed)
    seen = rng.integers(0, tr.SYMBOLS, 40)
    cuts = [0, 1, 9, 10, 25, 40]
    parts = [tr.summary(m, seen[a:b]) for a, b in zip(cuts, cuts[1:])]
    ends = tr.borders(m, parts, None, None)
    pieces = [tr.viterbi(m, seen[a:b], *e) for (a, b), e in zip(zip(cuts, cuts[1:]), ends)]
    assert (np.concatenate(pieces) == tr.viterbi(m, seen)).all()
    upper = [tr.joined(m, parts[:2]), tr.joined(m, parts[2:])]
    top = tr.borders(m, upper, None, None)
    assert tr.borders(m, parts[:2], *top[0]) + tr.borders(m, parts[2:], *top[1]) == ends


def test_viterbi_against_all_paths():
    from itertools import product

    m, seen = random_model(9), [3, 7, 1]
    score = lambda p: m.start[p[0]] + sum(m.emit[s, o] for s, o in zip(p, seen)) + sum(m.move[a, b] for a, b in zip(p, p[1:]))
    assert tuple(tr.viterbi(m, np.array(seen))) == max(product(range(tr.STATES), repeat=3), key=score)


@pytest.mark.parametrize(("line", "role", "rest"), [("User: hi", "user", "hi"), ("### Assistant", "assistant", ""), ("**Q:** x", "user", "x"), ("<|system|> s", "system", "s"), ("[AI] y", "assistant", "y"), ("plain text", None, "plain text"), ("", None, "")])
def test_markers(line, role, rest):
    kind, left = tr.marker(line)
    assert (tr.ROLES[kind - 2] if kind > 1 else None, left) == (role, rest)


def conversations(n=60):
    rows = []
    for c in range(n):
        rows.append((c, 0, "system", "Be brief."))
        for t in range(1, 2 + c % 6):
            rows.append((c, t, "user" if t % 2 else "assistant", "Why is that so?" if t % 2 else "Because of this. " * 12 + "\nAnd so on."))
    return rows


def found(df, model, block=256, fan=256):
    return sorted(map(tuple, tr.turns_of(tr.lines(df, role="role", block=block), model, fan).collect()), key=repr)


def test_roles_are_recovered_and_blocks_do_not_show(spark):
    df = spark.createDataFrame([(*r, "z", 1) for r in conversations()], "conv_id long, turn long, role string, text string, symbol string, line int")
    raw = tr.raw_transcripts(df)
    model = tr.fit(tr.lines(raw, role="role"))
    whole = tr.turns_of(tr.lines(raw, role="role"), model).collect()
    assert sum(r.role == r.truth for r in whole) >= 0.97 * len(whole)
    assert all(r.rendered == f"<|{r.role}|>\n{r.content}\n<|end|>\n" for r in whole)
    want = sorted(map(tuple, whole), key=repr)
    for block, fan in ((1, 2), (2, 2), (3, 256), (1_000_000, 256)):
        assert found(raw, model, block, fan) == want


def by_hand(rows, model):
    """The turns of ``conv, texts`` in order, each conversation decoded as a whole."""
    out = []
    for conv, texts in rows:
        given = []
        for turn, role, text in texts:
            blank = True
            for k, one in enumerate(text.split("\n")):
                given.append((turn, k, one, tr.symbol(one, blank), role))
                blank = not one.strip()
        path = tr.viterbi(model, np.array([g[3] for g in given]))
        starts = [i for i in range(len(path)) if path[i] % 2 == 0]
        for a, b in zip(starts, [*starts[1:], len(path)]):
            role = tr.ROLES[path[a] // 2]
            content = "\n".join([tr.marker(given[a][2])[1], *(g[2] for g in given[a + 1 : b])]).strip()
            out.append((conv, given[a][0], given[a][1], role, b - a, content, f"<|{role}|>\n{content}\n<|end|>\n", given[a][4]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "fan"), [(2, 2), (5, 3), (256, 256)])
def test_query_against_whole_conversations(spark, block, fan):
    rng = random.Random(block)
    rows = []
    for c in (1, 2, 3, None):
        for t in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"])
            rows.append((c, t, role, rng.choice(["User: ", "", "Assistant: "]) + "\n".join(rng.choice(["go on", "", "why?", "x" * 300]) for _ in range(rng.randrange(1, 30)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = tr.fit(tr.lines(df, role="role"))
    convs = [(c, [(t, r, x) for cc, t, r, x in rows if cc == c]) for c in (1, 2, 3, None)]
    assert found(df, model, block, fan) == by_hand(convs, model)


def test_a_turn_number_of_very_many_rows_is_spread(spark):
    df = spark.range(100_000).selectExpr("cast(id % 2 as long) * 0 + 7 as conv_id", "3 as turn", "'user' as role", "concat('User: line ', id) as text").unionByName(spark.createDataFrame([(8, 1, "user", "go on\n" * 70_000)], "conv_id long, turn int, role string, text string"))
    given = tr.lines(df, role="role")
    most = given.groupBy("block").count().agg({"count": "max"}).first()[0]
    assert most == 256 and given.select("block").distinct().count() > 600
    got = tr.turns_of(given, tr.fit(given))
    assert {r.conv: r.n for r in got.groupBy("conv").agg(F.sum("n_lines").alias("n")).collect()} == {7: 100_000, 8: 70_001}


def test_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", None), (1, 1, None, ""), (None, 0, "user", "x"), (2, None, "user", "x"), (2, 0, "user", "User: y"), (3, 0, "tool", "y"), (3, 0, "tool", "y"), (3, 0, "tool", "z"), (4, 0, "user", "a long line " * 50_000)]
    df = spark.createDataFrame(rows, schema)
    model = tr.fit(tr.lines(df, role="role"))
    got = tr.turns_of(tr.lines(df, role="role"), model).collect()
    assert {r.conv for r in got} == {None, 1, 2, 3, 4}
    assert sum(r.n_lines for r in got if r.conv == 3) == 3  # equal rows stay
    assert min((r for r in got if r.conv == 2), key=lambda r: (r.turn is not None, r.turn)).turn is None
    empty = tr.lines(df.limit(0), role="role")
    assert tr.turns_of(empty, tr.fit(empty)).count() == 0


def test_moves_are_counted_one_by_one(spark):
    long = "x\n" * 9 + "x"  # one turn of ten lines among turns of one
    rows = [(1, 0, "user", long), (1, 3, "assistant", "y"), (1, 700, "user", "y"), (1, 701, None, "y"), (1, 702, "assistant", "y"), (2, -5, "user", "y")]
    given = tr.lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), role="role")
    user, assistant = (2 * tr.ROLES.index(r) for r in ("user", "assistant"))
    expected = np.full((tr.STATES, tr.STATES), 0.5)
    expected[user, user + 1] += 1
    expected[user + 1, user + 1] += 8
    expected[user + 1, assistant] += 1
    expected[assistant, user] += 1
    expected[:, 1::2] *= np.array([[s // 2 == t for t in range(len(tr.ROLES))] for s in range(tr.STATES)])
    for block in (256, 2):
        assert np.allclose(np.exp(tr.fit(given, block=block).move), expected / expected.sum(1, keepdims=True))
