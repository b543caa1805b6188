import base64
import gzip
import hashlib
import io
import json
import zlib

import pytest

from keyloom.llm import warc

PAGES = [(1, "http://a/", "<p>x"), (2, "http://b/", "<p>x"), (5, "http://c/é\r\nX: y", "ü" * 70_000), (3, None, None), (4, "d", ""), (9, "e", "WARC/1.1\r\n\r\n\r\n\r\n"), (7, "f", "<p>x"), (7, "f", "<p>x")]


def check(rows, got):
    assert len(got) == len(rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        last = max(p for p, _, h in rows if (h or "").encode() == raw)
        for r in (r for r in got if r.page_id == page):
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if page == last else ("revisit", last))


@pytest.mark.parametrize("archive_bytes", [1, 200, 1 << 27])
def test_round_trip(spark, archive_bytes):
    df = spark.createDataFrame([(*r, "z") for r in PAGES], "page_id long, url string, html string, refers_to string")
    check(PAGES, warc.round_trip(df, archive_bytes).collect())


def test_no_rows_and_least_payload(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.round_trip(df.limit(0)).count() == 0
    got = {r.page_id: r.refers_to for r in warc.with_revisits(df, 5).collect()}
    assert set(got.values()) == {None}


def test_normalised_files_and_index(spark, tmp_path):
    raw, tidy = f"file://{tmp_path}/raw", f"file://{tmp_path}/tidy"
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    names = warc.write_archives(warc.with_revisits(df).coalesce(1), raw)
    one = names.first().archive
    member = zlib.decompressobj(31)
    member.decompress((tmp_path / "raw" / one).read_bytes())
    assert member.eof and not member.unused_data  # one member for the whole file
    index = warc.normalise(names, raw, tidy).collect()
    assert len(index) == len(PAGES)
    for r in index:
        data = (tmp_path / "tidy" / r.archive).read_bytes()[r.offset : r.offset + r.length]
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\n")
    lines = [json.loads(x) for f in (tmp_path / "tidy").glob("*.idx") for x in f.read_text().splitlines()]
    assert sorted((x["archive"], x["offset"]) for x in lines) == sorted((r.archive, r.offset) for r in index)
    assert not list(tmp_path.rglob("*.part"))


@pytest.mark.parametrize("form", ["whole", "members", "plain"])
def test_all_forms_are_read(form):
    records = [warc.record(i, f"http://x/{i}", b"y" * n) for i, n in enumerate((0, 10, 3_000_000, 5))]
    data = b"".join(records) if form == "plain" else gzip.compress(b"".join(records)) if form == "whole" else b"".join(map(warc.member, records))
    assert list(warc.split(io.BytesIO(data))) == records
    with pytest.raises(ValueError):
        list(warc.split(io.BytesIO(data[: len(data) * 2 // 3])))
    assert list(warc.split(io.BytesIO(b""))) == []


def test_null_ids(spark):
    rows = [(None, "u", "same"), (4, "u", "same"), (None, None, "alone"), (None, "v", "alone"), (None, "w", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    assert got == sorted([(None, 4, "revisit", 4), (4, 4, "response", None), (None, 5, "response", None), (None, 5, "response", None), (None, 0, "response", None)], key=repr)
