"""TIFF media columns: one row for each page of a baseline-or-better TIFF file.

The reader walks the chain of image directories in either byte order, decodes
uncompressed, PackBits, LZW and deflate strips or tiles, undoes the horizontal
(2) and floating-point (3) predictors, and joins planes.  The writer makes the
same kinds, so every decoder has an exact round trip to be tested with.

Depths are 1, 2, 4, 8, 16, 32 and 64 bits; samples under 8 bits come out as bytes.
Null and empty media have no page.  A page that cannot be read, and a chain that
breaks off, gives one row whose ``error`` says why, and null samples; the pages before
and after it are given.  ``n_pages`` counts the pages that were read.  Equal files give equal rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, texts, values

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}


class TiffError(ValueError):
    pass


#: What damaged bytes raise: ours, the decoders', and those of senseless sizes.
DAMAGE = (ValueError, IndexError, TypeError, ZeroDivisionError, MemoryError, zlib.error, struct.error)
#: Each byte with its bits in the other order.
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


@dataclass
class Page:
    width: int
    height: int
    samples_per_pixel: int
    bits: int
    compression: int
    data: bytes  # rows from the top, samples of a pixel together, in the machine's (little-endian) order; a byte for each of 1, 2 or 4 bits


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    """Stops once there are ``most`` bytes, as all decoders do: damaged data may swell without end."""
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Most significant bit first; a width grows one code early, as TIFF writers do."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, previous, out = list(first), 9, None, []
    bits = have = size = 0
    for byte in data:
        bits = (bits << 8) | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            table, width, previous = list(first), 9, None
            continue
        if code == 257:
            break
        if previous is None:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise TiffError("LZW code beyond the table")
            table.append(previous + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        size += len(entry)
        if most is not None and size >= most:
            break
        previous = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits = (bits << width) | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have)
            bits &= (1 << have) - 1

    first = {bytes((i,)): i for i in range(256)}
    table, width, size, w = dict(first), 9, 258, b""
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        put(table[w], width)
        table[w + c] = size
        size += 1
        if size >= (1 << width):
            width += 1
        if size >= 4094:
            put(256, min(width, 12))
            table, width, size = dict(first), 9, 258
        w = c
    if w:
        put(table[w], width)
        size += 1
        if size >= (1 << width) and width < 12:
            width += 1
    put(257, min(width, 12))
    if have:
        out.append((bits << (8 - have)) & 0xFF)
    return bytes(out)


def inflate(data: bytes, most: int | None = None) -> bytes:
    if most is None:
        return zlib.decompress(data)
    stream = zlib.decompressobj()
    out = stream.decompress(data, max(1, most))
    if not stream.eof:
        stream.decompress(stream.unconsumed_tail, 1)  # reads, and tests, the checksum where the data end here
    return out


_DECODERS = {NONE: lambda data, most: data, PACKBITS: unpack_bits, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate}
#: No decoder makes more bytes of one (LZW comes nearest), so larger pages are damaged ones.
SWELL = 1500
_ENCODERS = {NONE: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6)}


def _undo(data: bytes, predictor: int, width: int, rows: int, planes: int, bits: int, order: str) -> np.ndarray:
    """Samples of a strip or tile as rows x width x planes, in native order."""
    if bits in (1, 2, 4):
        if predictor != 1:
            raise TiffError(f"predictor {predictor} of {bits} bits a sample")
        line = -(-width * planes * bits // 8)  # a row begins with a byte
        if len(data) < line * rows:
            raise TiffError(f"a strip or tile has {len(data)} bytes of {line * rows}")
        packed = np.frombuffer(data, dtype=np.uint8, count=line * rows).reshape(rows, line, 1)
        samples = packed >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)
        return samples.reshape(rows, -1)[:, : width * planes].reshape(rows, width, planes)
    if bits not in (8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample")
    kind = np.dtype(f"{order}u{bits // 8}")
    need = width * rows * planes * kind.itemsize
    if len(data) < need:
        raise TiffError(f"a strip or tile has {len(data)} bytes of {need}")
    raw = np.frombuffer(data, dtype=np.uint8, count=need)
    if predictor == 3:
        split = raw.reshape(rows, kind.itemsize, width * planes)
        line = split.reshape(rows, -1, planes) if planes > 1 else split.reshape(rows, -1, 1)
        line = np.cumsum(line, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * planes)
        native = np.ascontiguousarray(line[:, ::-1, :].transpose(0, 2, 1))  # the planes are most significant first
        return native.reshape(-1).view(f"<u{bits // 8}").reshape(rows, width, planes)
    x = raw.view(kind).astype(kind.newbyteorder("<")).reshape(rows, width, planes)
    if predictor == 2:
        return np.cumsum(x, axis=1, dtype=x.dtype)
    if predictor != 1:
        raise TiffError(f"predictor {predictor}")
    return x


def _directory(media: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    if at + 2 > len(media):
        raise TiffError("a directory lies beyond the end")
    (n,) = struct.unpack_from(order + "H", media, at)
    if at + 6 + 12 * n > len(media):
        raise TiffError("a directory is cut short")
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        if not size or kind not in _CODES:
            continue
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", media, place)
        if place + size > len(media):
            raise TiffError(f"the values of tag {tag} lie beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{count}{_CODES[kind]}", media, place)
    return tags, struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories.  A chain that loops is an error, as is a page that cannot be read."""
    for page in attempts(media):
        if isinstance(page, Exception):
            raise page
        yield page


def attempts(media: bytes) -> Iterator[Page | Exception]:
    """The pages of a file; in place of one that cannot be read, or of the rest of a broken chain, the error."""
    try:
        for tags, order in _chain(media):
            try:
                yield _page(media, tags, order)
            except DAMAGE as e:
                yield e
    except DAMAGE as e:
        yield e


def _chain(media: bytes) -> Iterator[tuple[dict[int, tuple], str]]:
    if media[:4] == b"II*\0":
        order = "<"
    elif media[:4] == b"MM\0*":
        order = ">"
    else:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", media, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a loop")
        seen.add(at)
        tags, at = _directory(media, at, order)
        yield tags, order


def _page(media: bytes, tags: dict[int, tuple], order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height = one(256), one(257)
    if not width or not height:
        raise TiffError("a page has no size")
    planes, bits, compression, predictor = one(277, 1), one(258, 1), one(259, NONE), one(317, 1)
    if any(b != bits for b in tags.get(258, ())):
        raise TiffError("samples of differing depth")
    if compression not in _DECODERS:
        raise TiffError(f"compression {compression}")
    separate = one(284, 1) == 2 and planes > 1
    kind = np.dtype(f"<u{max(8, bits) // 8}") if bits in (1, 2, 4, 8, 16, 32, 64) else None
    if kind is None:
        raise TiffError(f"{bits} bits a sample")
    tiled = 322 in tags
    w, h = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
    starts, sizes = (tags.get(324), tags.get(325)) if tiled else (tags.get(273), tags.get(279))
    if not w or not h or not planes or min(w, h, planes) < 0:
        raise TiffError("a strip, tile or pixel has no size")
    across, down = -(-width // w), -(-height // h)
    if not starts or not sizes or len(starts) < across * down * (planes if separate else 1) or len(sizes) < len(starts):
        raise TiffError("strips or tiles are missing")
    step = planes if separate else 1
    row_bytes = -(-w * (planes // step) * bits // 8)
    cells = across * down * step
    if row_bytes * h * cells > SWELL * (sum(min(s, len(media)) for s in sizes[:cells]) + 64):
        raise TiffError(f"{len(media)} bytes cannot hold a page of {width} x {height} x {planes}")
    image = np.empty((height, width, planes), dtype=kind)
    for k in range(across * down * step):
        plane, cell = divmod(k, across * down)
        y, x = (cell // across) * h, (cell % across) * w
        rows = h if tiled else min(h, height - y)
        if starts[k] + sizes[k] > len(media):
            raise TiffError("a strip or tile lies beyond the end")
        packed = media[starts[k] : starts[k] + sizes[k]]
        raw = _DECODERS[compression](packed.translate(_MIRRORED) if bits < 8 and one(266, 1) == 2 else packed, row_bytes * rows)
        part = _undo(raw, predictor, w, rows, 1 if separate else planes, bits, order)[: height - y, : width - x]
        image[y : y + rows, x : x + w, plane : plane + 1 if separate else planes] = part
    return Page(width, height, planes, bits, compression, image.tobytes())


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<", separate: bool = False) -> bytes:
    """A file with a page for each (height, width) or (height, width, planes) array of unsigned samples, or of floats with predictor 3."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for image in images:
        a = image if image.ndim == 3 else image[:, :, None]
        height, width, planes = a.shape
        bits = a.dtype.itemsize * 8
        groups = [a[:, :, p : p + 1] for p in range(planes)] if separate else [a]
        chunks = []
        for g in groups:
            if tile:
                tw, th = tile
                for y in range(0, height, th):
                    for x in range(0, width, tw):
                        cell = g[y : y + th, x : x + tw]
                        chunks.append(np.pad(cell, ((0, th - cell.shape[0]), (0, tw - cell.shape[1]), (0, 0)), mode="edge"))
            else:
                chunks += [g[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        places, sizes = [], []
        for c in chunks:
            raw = _ENCODERS[compression](_predict(c, predictor, order))
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [bits] * planes), 259: (3, [compression]), 262: (3, [1]), 277: (3, [planes]), 284: (3, [2 if separate else 1]), 317: (3, [predictor])}
        tags |= {339: (3, [3 if a.dtype.kind == "f" else 1] * planes)}
        tags |= {322: (4, [tile[0]]), 323: (4, [tile[1]]), 324: (4, places), 325: (4, sizes)} if tile else {273: (4, places), 278: (4, [rows_per_strip]), 279: (4, sizes)}
        entries = b""
        for tag in sorted(tags):
            kind, v = tags[tag]
            body = struct.pack(f"{order}{len(v)}{_CODES[kind]}", *v)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(v)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _predict(cell: np.ndarray, predictor: int, order: str) -> bytes:
    rows, width, planes = cell.shape
    if predictor == 3:
        size = cell.dtype.itemsize
        split = np.ascontiguousarray(cell.astype(f"<{cell.dtype.kind}{size}")).view(np.uint8).reshape(rows, width * planes, size)[:, :, ::-1].transpose(0, 2, 1)
        line = np.ascontiguousarray(split).reshape(rows, -1, planes)
        line = np.concatenate([line[:, :1], np.diff(line, axis=1)], axis=1)
        return line.tobytes()
    x = cell.astype(f"<{cell.dtype.kind}{cell.dtype.itemsize}")
    if predictor == 2:
        x = np.concatenate([x[:, :1], np.diff(x, axis=1)], axis=1)
    return x.astype(x.dtype.newbyteorder(order)).tobytes()


PAGES = "page int, n_pages int, width int, height int, samples_per_pixel int, bits int, compression int, samples binary, error string"


def with_pages(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """One row for each page of each file, with the ``keep`` columns (all but the media by default).

    Columns of the page (``PAGES``) replace columns of the same names.
    """
    fields = T.StructType.fromDDL(PAGES).fields
    kept = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in fields} and (keep is not None or c != media)]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept), *fields])

    def make():
        def each(batch):
            rows, found = [], []
            for i, raw in enumerate(texts(batch, media)):
                if not raw:
                    continue
                mine = list(attempts(raw))
                n = sum(isinstance(p, Page) for p in mine)
                for k, p in enumerate(mine):
                    bad = isinstance(p, Exception)
                    found.append((k, n, *([None] * 6), str(p) or type(p).__name__) if bad else (k, n, p.width, p.height, p.samples_per_pixel, p.bits, p.compression, p.data, None))
                rows += [i] * len(mine)
            if rows:
                yield {c: batch.column(batch.schema.get_field_index(c)).take(rows) for c in kept} | {f.name: [x[k] for x in found] for k, f in enumerate(fields)}

        return each

    return in_batches(df.select(*dict.fromkeys([*kept, media])), schema, make)


def payload(text: bytes, unit: int = 64) -> bytes:
    """The text with zeros up to a positive multiple of ``unit``."""
    return text + b"\0" * (unit * max(1, -(-len(text) // unit)) - len(text))


def with_media(df: DataFrame, text: str = "text", name: str = "media", compression: int = DEFLATE, predictor: int = 2, width: int = 64, keep: list[str] | None = None) -> DataFrame:
    """Stores each whole text (null: empty) as a one-page 8-bit image ``width`` samples wide, with ``n_bytes``."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in (name, "n_bytes")]
    schema = T.StructType([*(f for f in df.schema.fields if f.name in kept), T.StructField("n_bytes", T.LongType()), T.StructField(name, T.BinaryType())])

    def make():
        def each(batch):
            given = texts(batch, text)
            files = [write([np.frombuffer(payload(t, width), dtype=np.uint8).reshape(-1, width)], compression, predictor) for t in given]
            yield {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {"n_bytes": [len(t) for t in given], name: files}

        return each

    return in_batches(df.select(*dict.fromkeys([*kept, text])), schema, make)


def average_hash(samples: bytes, width: int) -> str:
    """64 bits: which cells of an 8 x 8 grid over the image are brighter than the whole.  Rows are dealt to the grid by their share of the height."""
    a = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    edges = np.linspace(0, a.shape[0], 9).astype(int)
    rows = np.add.reduceat(a.astype(np.int64).reshape(a.shape[0], 8, -1).sum(2), np.minimum(edges[:-1], a.shape[0] - 1), axis=0)
    n = np.maximum(np.diff(edges), 1)[:, None] * (width // 8)
    bits = (rows / n) > a.mean()
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def with_features(df: DataFrame) -> DataFrame:
    """Adds ``feature``, the :func:`average_hash` of each 8-bit page, in place of ``samples``."""
    kept = [f for f in df.schema.fields if f.name not in ("samples", "feature")]

    def make():
        def each(batch):
            wide, given = values(batch, "width"), texts(batch, "samples")
            yield {f.name: batch.column(batch.schema.get_field_index(f.name)) for f in kept} | {"feature": [average_hash(s, w) if s else None for s, w in zip(given, wide)]}

        return each

    return in_batches(df, T.StructType([*kept, T.StructField("feature", T.StringType())]), make)
