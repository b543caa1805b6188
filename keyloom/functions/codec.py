"""Byte forms of batches, internal keys and entries (driver and source side)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from keyloom.schema import DELETE, SET

HEADER_BYTES = 12


class CodecError(ValueError):
    pass


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, next position)."""
    n = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise CodecError("a varint is cut short")
        b = raw[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def internal_key(key: bytes, seq: int, kind: int) -> bytes:
    return key + (seq << 8 | kind).to_bytes(8, "big")


def split_internal_key(raw: bytes) -> tuple[bytes, int, int]:
    if len(raw) <= 8:
        raise CodecError("an internal key needs a user key and eight bytes")
    meta = int.from_bytes(raw[-8:], "big")
    return raw[:-8], meta >> 8, meta & 0xFF


def entry(key: bytes, value: bytes) -> bytes:
    return put_varint(len(key)) + key + put_varint(len(value)) + value


def entries(block: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The entries of a block, up to its zero padding."""
    at = 0
    while at < len(block):
        n, at = get_varint(block, at)
        if not n:
            return
        key, at = block[at : at + n], at + n
        n, at = get_varint(block, at)
        yield key, block[at : at + n]
        at += n


def block(pairs: list[tuple[bytes, bytes]], size: int = 4096) -> bytes:
    """Entries of serialized keys and values, zero-padded to ``size``; one that is larger has a longer block of its own."""
    return b"".join(entry(k, v) for k, v in pairs).ljust(size, b"\0")


@dataclass
class Batch:
    """Operations that are applied together, with consecutive sequence numbers.

    An empty key is refused.  A null value in ``set`` is an empty one: only a
    deletion has none.
    """

    ops: list[tuple[int, bytes, bytes | None]] = field(default_factory=list)
    seq: int = 0
    committed: bool = False

    def set(self, key: bytes | str, value: bytes | str | None) -> Batch:
        return self._add(SET, key, b"" if value is None else value)

    def delete(self, key: bytes | str) -> Batch:
        return self._add(DELETE, key, None)

    def _add(self, kind: int, key: bytes | str, value: bytes | str | None) -> Batch:
        k, v = (x.encode() if isinstance(x, str) else x for x in (key, value))
        if not k:
            raise ValueError("a key needs at least one byte")
        self.ops.append((kind, k, v))
        return self

    def __len__(self) -> int:
        return len(self.ops)

    def __iter__(self) -> Iterator[tuple[int, int, bytes, bytes | None]]:
        """(kind, seq, key, value) with the batch's base sequence number."""
        for i, (kind, key, value) in enumerate(self.ops):
            yield kind, self.seq + i, key, value

    def encode(self) -> bytes:
        head = put_varint(self.seq) + len(self.ops).to_bytes(4, "little")
        out = [head.ljust(HEADER_BYTES, b"\0")]
        for kind, key, value in self.ops:
            out += [bytes((kind,)), put_varint(len(key)), key]
            if kind == SET:
                out += [put_varint(len(value or b"")), value or b""]
        return b"".join(out)

    @classmethod
    def decode(cls, raw: bytes) -> Batch:
        seq, at = get_varint(raw, 0)
        count = int.from_bytes(raw[at : at + 4], "little")
        batch, at = cls(seq=seq), max(HEADER_BYTES, at + 4)
        for _ in range(count):
            if at >= len(raw):
                raise CodecError("a batch is cut short")
            kind = raw[at]
            n, at = get_varint(raw, at + 1)
            key, at = raw[at : at + n], at + n
            value = None
            if kind == SET:
                n, at = get_varint(raw, at)
                value, at = raw[at : at + n], at + n
            batch.ops.append((kind, key, value))
        return batch


def frames(batches: list[bytes], block: int = 4096) -> bytes:
    """Length-prefixed records in zero-padded blocks.  A record that no block can hold gets a run of blocks of its own."""
    out, used = bytearray(), 0
    for raw in batches:
        one = put_varint(len(raw)) + raw
        if used and used + len(one) > block:
            out += b"\0" * (block - used)
            used = 0
        out += one
        used = (used + len(one)) % block if used + len(one) > block else used + len(one)
        if used == block:
            used = 0
    if used:
        out += b"\0" * (block - used)
    return bytes(out)


def records(raw: bytes, block: int = 4096) -> Iterator[bytes]:
    """The records of :func:`frames`: a zero length means the next block.  An empty log has none."""
    at = 0
    while at < len(raw):
        n, start = get_varint(raw, at)
        if not n:
            at = (at // block + 1) * block
            continue
        if start + n > len(raw):
            raise CodecError("a log record is cut short")
        yield raw[start : start + n]
        at = start + n
