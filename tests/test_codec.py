import pytest
from hypothesis import given
from hypothesis import strategies as st

from keyloom.functions import codec
from keyloom.functions.codec import Batch
from keyloom.schema import DELETE, SET

OPS = st.lists(st.tuples(st.sampled_from([SET, DELETE]), st.binary(min_size=1, max_size=40), st.binary(max_size=60)), max_size=20)


def build(ops, seq=0):
    b = Batch(seq=seq)
    for kind, k, v in ops:
        b.set(k, v) if kind == SET else b.delete(k)
    return b


def test_batch_bytes():
    b = Batch()
    for i in range(4):
        b.set(f"test{i}", "testVal")
    golden = bytes([0, 4, 0, 0, 0]) + bytes(7) + b"".join(b"\x00\x05test%d\x07testVal" % i for i in range(4))
    assert b.encode() == golden


def test_batch_order_and_sequences():
    b = Batch(seq=100)
    for i in range(4):
        b.set(f"test{i}", "testVal")
    b.delete("test4")
    again = Batch.decode(b.encode())
    assert len(again) == 5
    assert [seq for _, seq, _, _ in again] == list(range(100, 105))
    assert list(again)[-1] == (DELETE, 104, b"test4", None)


@given(OPS, st.integers(0, 2**50))
def test_batch_round_trip(ops, seq):
    b = build(ops, seq)
    again = Batch.decode(b.encode())
    assert again.ops == b.ops and again.seq == seq


@given(st.lists(st.binary(min_size=1, max_size=6000), max_size=12))
def test_log_round_trip(raws):
    assert list(codec.records(codec.frames(raws))) == raws


def test_empty_log_and_empty_key():
    assert list(codec.records(b"")) == []
    with pytest.raises(ValueError):
        Batch().set(b"", b"x")


def test_null_value_is_empty():
    assert Batch.decode(Batch().set("a", None).set("b", "c").encode()).ops == [(SET, b"a", b""), (SET, b"b", b"c")]


@given(st.binary(min_size=1, max_size=30), st.integers(0, (1 << 55) - 1), st.sampled_from([0, 1]))
def test_internal_key(key, seq, kind):
    assert codec.split_internal_key(codec.internal_key(key, seq, kind)) == (key, seq, kind)


def test_internal_key_golden():
    assert codec.internal_key(b"testKey", 10000, SET).hex().upper() == "746573744B65790000000000271000"


def test_block_entries_stop_at_padding():
    block = (codec.entry(b"a", b"1") + codec.entry(b"b", b"")).ljust(4096, b"\0")
    assert list(codec.entries(block)) == [(b"a", b"1"), (b"b", b"")]
