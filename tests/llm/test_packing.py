import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabulary
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import packing

FILES = (vocabulary.path("byte_bpe_50k.json"), vocabulary.path("byte_bpe_50k.tiktoken"), vocabulary.PATTERN)


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*FILES)


TEXT = st.one_of(st.text(max_size=60), st.text("ab ,.'\n\té1<|>", max_size=60), st.lists(st.sampled_from(["the", "don't", " ", "  ", "\n", " \n", "Über", "<|endoftext|>", "12,5", "\u00a0", "日本", "\x1c", "a\u0301"]), max_size=20).map("".join))


@given(t=TEXT)
@settings(deadline=None, max_examples=400)
def test_ids_are_the_tokenizers(encoder, t):
    want = encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(t), dtype=encoder.dtype).tolist() == want


@pytest.mark.parametrize("t", ["\n" * 1_500_000, "a\n" + "\n" * 1_500_000 + "b", "a" * 400_000, "7" * 400_000 + "\n\n", "! " * 200_000])
def test_very_long_uniform_texts(encoder, t):
    want = np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype=encoder.dtype).tobytes()
    assert encoder.ids(t) == want
    assert packing.Encoder(FILES[0]).ids(t) == want


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b, c, d] for a in range(8) for b in range(8) for c in range(8) for d in range(8)], dtype=np.uint32)
    order = np.argsort(packing.hilbert(cells, 3))
    assert sorted(packing.hilbert(cells, 3).tolist()) == list(range(8**4))
    assert (np.abs(np.diff(cells[order].astype(int), axis=0)).sum(1) == 1).all()


def check(rows, got, encoder, length):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for key, t in rows:
        ids = np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    short = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        short += at < length
    assert short <= 1 and sorted(by_seq) == list(range(len(by_seq)))


def test_pieces_cover_everything_with_one_short_sequence(spark, encoder):
    rows = [(i, f"word{i % 7} and more of it, " * (1 + i % 40)) for i in range(150)] + [(900, None), (901, ""), (902, "x y " * 60_000), (None, "no key")]
    rows += [(1000 + i, "one hot text") for i in range(80)]
    df = spark.createDataFrame([(i, t, 3, "z") for i, t in rows], "doc_id long, text string, start long, ids string")
    check(rows, packing.pack(df, *FILES, length=128).collect(), encoder, 128)
    assert packing.pack(df.limit(0), *FILES).count() == 0


def test_repeated_rows_are_packed_each_time(spark):
    df = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    got = packing.pack(df, *FILES, length=2048, with_ids=True).collect()
    assert [r.length for r in got] == [got[0].length] * 3 and sum(r.length for r in got) == 3 * got[0].doc_tokens
    assert len({tuple(r.ids) for r in got}) == 1


def test_neighbours_are_alike(spark):
    topics = ["the cat sat on the mat with the hat ", "quantum flux tensor gauge lattice field ", "sugar flour butter oven bake cake cream "]
    rows = [(i, topics[i % 3] * 30 + f"number {i}") for i in range(90)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), *FILES, length=4096).collect()
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    changes = sum(a % 3 != b % 3 for a, b in zip(order, order[1:]))
    assert changes < 30  # 60 in a random order


def test_buckets_follow_the_bytes(spark, encoder, monkeypatch):
    monkeypatch.setattr(packing, "TASK_BYTES", 2000)
    monkeypatch.setattr(packing, "QUANTILES", 10)
    rows = [(i, f"word{i % 97} and {i} more of it, " * (1 + i % 9)) for i in range(400)] + [(1000 + i, "one hot text") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spread = packing._bounds(packing.tokenised(df, *FILES, 1, "doc_id", "text"), 120)
    assert len(spread) > 40
    check(rows, packing.pack(df, *FILES, length=128).collect(), encoder, 128)
