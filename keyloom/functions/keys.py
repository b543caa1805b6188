"""Internal keys as column expressions: packed metadata, byte form, order, sizes, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.schema import ENTRY_RESERVE, META_BYTES


def pack_meta(seq: Column, kind: Column) -> Column:
    """Sequence number and kind in one long."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long"))


def meta_seq(meta: Column) -> Column:
    return F.shiftrightunsigned(meta, 8)


def meta_kind(meta: Column) -> Column:
    return meta.bitwiseAND(F.lit(0xFF)).cast("tinyint")


def serialize(key: Column, seq: Column, kind: Column) -> Column:
    """Key bytes and eight big-endian bytes of metadata.  The bytes of one key order by rising sequence; sort by columns instead."""
    return F.concat(key.cast("binary"), F.unhex(F.lpad(F.hex(pack_meta(seq, kind)), 16, "0")))


def deserialize(raw: Column) -> Column:
    """``struct(key, seq, kind)`` of a serialized internal key."""
    n = F.octet_length(raw)
    tail = F.hex(raw.substr(n - META_BYTES + 1, F.lit(META_BYTES)))
    high, low = (F.conv(F.substring(tail, a, 8), 16, 10).cast("long") for a in (1, 9))
    meta = F.shiftleft(high, 32).bitwiseOR(low)
    return F.struct(raw.substr(F.lit(1), n - META_BYTES).alias("key"), meta_seq(meta).alias("seq"), meta_kind(meta).alias("kind"))


def describe(key: Column, seq: Column, kind: Column) -> Column:
    return F.concat(F.lit("UserKey: "), key.cast("string"), F.lit(" SeqNum: "), seq.cast("string"), F.lit(" Kind: "), kind.cast("string"))


def internal_order(key: str = "key", seq: str = "seq", kind: str = "kind") -> list[Column]:
    """Key bytes rising, then the newest first."""
    return [F.col(key).asc(), F.col(seq).desc(), F.col(kind).desc()]


def entry_bytes(key: Column, value: Column) -> Column:
    """What a version takes of a memtable's budget."""
    return (F.octet_length(key) + META_BYTES + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def reserved_bytes(key: Column, value: Column) -> Column:
    """What a version must find free in a block."""
    return entry_bytes(key, value) + ENTRY_RESERVE


def log_name(number: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 9, "0"), F.lit(".log"))


def log_number(name: Column) -> Column:
    """The number in a log file's name or path, or null."""
    return F.regexp_extract(name, r"(?:^|/)(\d{1,18})\.log$", 1).try_cast("bigint")


def varint(n: Column) -> Column:
    """Seven bits a byte, the lowest first, all but the last byte with the high bit set; for numbers below 2^35."""
    step = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(0x7F))
    byte = lambda x: F.unhex(F.lpad(F.hex(x), 2, "0"))
    parts = [F.when(n < 1 << 7 * (i + 1), byte(step(i))).otherwise(byte(step(i).bitwiseOR(F.lit(0x80)))) for i in range(5)]
    return F.concat(parts[0], *[F.when(n >= 1 << 7 * i, parts[i]).otherwise(F.lit(b"")) for i in range(1, 5)])


def entry(key: Column, value: Column) -> Column:
    """The byte form of an entry: length and bytes of the serialized key, length and bytes of the value."""
    held = F.coalesce(value.cast("binary"), F.lit(b""))
    return F.concat(varint(F.octet_length(key).cast("long")), key, varint(F.octet_length(held).cast("long")), held)


def table_id(name: Column) -> Column:
    """A table's identity, in hex: its name's bytes and the digest of nothing."""
    return F.concat(F.lower(F.hex(F.encode(name, "UTF-8"))), F.sha2(F.lit(b""), 256))
