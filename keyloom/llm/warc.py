"""WARC: whole-file gzip archives, normalised to one gzip member for each record.

Many archives come as one gzip stream over the whole file, which can only be read
from the start.  The normaliser inflates such a stream once, rewrites each record
as a member of its own, and writes an index beside the file, so that any record
can then be read by its offset.  It streams: memory holds one record and a few
buffers whatever the file's size, and files that have a member for each record
already (or are not compressed) are read the same way.

Writers name files afresh on each attempt and list them only when their task is
done, so a lost executor leaves files that no list names.  A null payload is
empty.  Equal payloads of at least ``min_payload`` bytes are written once, in the
record with the largest id; the others are ``revisit`` records.  Repeated ids with
that largest id are all responses.  A null id is written as an empty one and read back
as null; it is less than any other, and where equal payloads have no other all are responses.  Control characters in a URL are percent-encoded;
a null URL is ``urn:page:<id>``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import in_batches, new_path, partitions, stored, texts, values

CHUNK = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A response record, or with ``refers_to`` a revisit, whose block keeps only the HTTP header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = record_id(page)[1:-1] if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    found = {}
    for line in raw.split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if sep:
            found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "surrogateescape")
    return found


class Inflater:
    """Reads a file as plain bytes: one gzip member, many, or none."""

    def __init__(self, source: BinaryIO):
        self.source, self.rest = source, b""
        self.member = None
        self.plain: bool | None = None

    def read(self) -> bytes:
        """Some more bytes; empty at the end."""
        while True:
            raw = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not raw:
                if self.member is not None:
                    raise ValueError("the archive ends within a gzip member")
                return b""
            if self.plain is None:
                self.plain = raw[:2] != b"\x1f\x8b"
            if self.plain:
                return raw
            if self.member is None:
                self.member = zlib.decompressobj(31)
            out = self.member.decompress(raw, CHUNK)
            if self.member.eof:
                self.rest, self.member = self.member.unused_data.lstrip(b"\0"), None
            else:
                self.rest = self.member.unconsumed_tail
            if out:
                return out


def split(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, each with its header and closing line ends."""
    inflater, buffer, position = Inflater(source), bytearray(), 0
    more = True

    def need(n: int) -> bool:
        nonlocal more
        while len(buffer) - position < n and more:
            got = inflater.read()
            more = bool(got)
            buffer.extend(got)
        return len(buffer) - position >= n

    while True:
        if position > 4 * CHUNK:
            del buffer[:position]
            position = 0
        while need(2) and buffer[position : position + 2] == b"\r\n":  # spare line ends between records
            position += 2
        if not need(1):
            return
        while (end := buffer.find(b"\r\n\r\n", position)) < 0:
            if not need(len(buffer) - position + 1):
                raise ValueError("the archive ends within a record's header")
        size = int(headers(bytes(buffer[position:end]))["content-length"])
        total = end + 4 - position + size
        if not need(total):
            raise ValueError("the archive ends within a record's block")
        need(total + 4)
        tail = 4 if buffer[position + total : position + total + 4] == b"\r\n\r\n" else 0
        yield bytes(buffer[position : position + total]) + b"\r\n\r\n"
        position += total + tail


def member(raw: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class _Monolith:
    """A whole-file gzip stream that is moved to its name when it is complete."""

    def __init__(self, folder: str, level: int = 6):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.gz"
        self.path = f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        self.size = self.records = 0

    def add(self, raw: bytes) -> None:
        self.out.write(self.pack.compress(raw))
        self.size += len(raw)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.write(self.pack.flush())
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return self.name, self.records


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 128 << 20) -> DataFrame:
    """Writes ``page_id, url, html, refers_to`` rows to whole-file gzip archives; returns their list (a stored table).

    A new archive begins once one holds ``archive_bytes`` before compression.
    """

    def make():
        open_one: list[_Monolith] = []

        def close():
            name, n = open_one.pop().close()
            return {"archive": [name], "records": [n]}

        def each(batch):
            for page, url, html, to in zip(values(batch, "page_id"), values(batch, "url"), texts(batch, "html"), values(batch, "refers_to")):
                if not open_one:
                    open_one.append(_Monolith(folder))
                open_one[0].add(record(page, url, html, to))
                if open_one[0].size >= archive_bytes:
                    yield close()

        each.finish = lambda: [close()] if open_one else []
        return each

    return stored(in_batches(pages.select("page_id", "url", "html", "refers_to"), "archive string, records long", make), "warc-list")


def normalise(archives: DataFrame, folder: str, to: str) -> DataFrame:
    """Rewrites each listed archive with a member for each record; returns the index (a stored table).

    The same index is written beside each new archive, a JSON line for each record.
    """

    def make():
        source_fs, source = pafs.FileSystem.from_uri(folder)
        target_fs, target = pafs.FileSystem.from_uri(to)
        target_fs.create_dir(target, recursive=True)

        def each(batch):
            for name in values(batch, "archive"):
                new, at = f"{uuid.uuid4().hex}.warc.gz", 0
                part = f"{target}/{new}.part"
                rows: list[tuple] = []
                with source_fs.open_input_stream(f"{source}/{name}", compression=None) as raw, target_fs.open_output_stream(part, compression=None) as out, target_fs.open_output_stream(f"{target}/{new}.idx", compression=None) as index:
                    for one in split(raw):
                        head = headers(one[: one.index(b"\r\n\r\n")])
                        packed = member(one)
                        out.write(packed)
                        row = (new, at, len(packed), head["warc-record-id"], head["warc-type"])
                        index.write((json.dumps(dict(zip(("archive", "offset", "length", "record_id", "type"), row))) + "\n").encode())
                        rows.append(row)
                        at += len(packed)
                        if len(rows) == 4096:
                            yield dict(zip(("archive", "offset", "length", "record_id", "record_type"), map(list, zip(*rows))))
                            rows = []
                target_fs.move(part, f"{target}/{new}")
                if rows:
                    yield dict(zip(("archive", "offset", "length", "record_id", "record_type"), map(list, zip(*rows))))

        return each

    spread = archives.select("archive").repartition(partitions(archives.sparkSession), "archive")
    return stored(in_batches(spread, "archive string, offset long, length long, record_id string, record_type string", make), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads each indexed record at its offset, checks its digest, and returns what it says."""

    def make():
        fs, root = pafs.FileSystem.from_uri(folder)
        opened: dict[str, object] = {}

        def each(batch):
            rows = []
            for name, at, size in zip(values(batch, "archive"), values(batch, "offset"), values(batch, "length")):
                if name not in opened:
                    for f in opened.values():
                        f.close()
                    opened.clear()
                    opened[name] = fs.open_input_file(f"{root}/{name}")
                one = zlib.decompress(opened[name].read_at(size, at), 31)
                end = one.index(b"\r\n\r\n")
                head = headers(one[:end])
                block = one[end + 4 : end + 4 + int(head["content-length"])]
                cut = block.index(b"\r\n\r\n")
                payload, length = block[cut + 4 :], int(headers(block[:cut])["content-length"])
                wanted = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(payload) != length or digest(payload) != wanted):
                    raise ValueError(f"{head['warc-record-id']}: its payload is not what its header says")
                to = head.get("warc-refers-to")
                rows.append((_page(head["warc-record-id"]), length, wanted, head["warc-type"], _page(to) if to else None))
            yield dict(zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), map(list, zip(*rows))))

        each.finish = lambda: [f.close() for f in opened.values()] and []
        return each

    return in_batches(index.select("archive", "offset", "length"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", make)


def _page(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def with_revisits(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Adds ``refers_to``: null for responses, else the largest id with the same payload."""
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("_digest"))
    groups = keyed.where(F.octet_length("html") >= min_payload).groupBy("_digest").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    joined = keyed.join(groups.select("_digest", "_last"), "_digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last")).alias("refers_to"))


def round_trip(pages: DataFrame, archive_bytes: int = 128 << 20, min_payload: int = 0) -> DataFrame:
    """Writes all pages to whole-file archives, normalises them, and reads every record back by its offset."""
    spark = pages.sparkSession
    raw, tidy = new_path(spark, "warc-raw"), new_path(spark, "warc")
    archives = write_archives(with_revisits(pages, min_payload), raw, archive_bytes)
    return read_records(normalise(archives, raw, tidy), tidy)
