"""Exact substring deduplication with Burrows-Wheeler transforms of corpus blocks.

Each byte covered by a ``length``-byte string that also starts anywhere else in the
corpus (another text or the same) is removed; strings are judged on the input.

1.  Every window of ``length`` bytes is assigned to its anchor, the leftmost of its
    80-byte strings with the least hash.  Equal windows have equal anchors at equal
    distances, so windows can be compared anchor by anchor.  The bytes that an
    anchor's windows span are its segment.
2.  Anchors that occur once have no repeated window.  A segment that occurs twice is
    repeated whole.  What is left are anchors with differing segments, in essence
    the two edges of each shared passage.
3.  Those segments are gathered by anchor into blocks.  A block's suffixes are
    sorted, and a breadth-first backward extension on its Burrows-Wheeler transform
    finds the common prefixes of neighbours by increasing value, stopping at
    ``length``: neighbours without a value by then share ``length`` bytes.
4.  An anchor with more segments than a block holds is not gathered.  Its windows are
    split by their distance from the anchor into ranges, first of 16, then of 4, then
    single.  The bytes that all windows of a range share are the key of a new group,
    and those that any of them covers its segment, so the same steps decide it: keys
    that occur once go, equal segments are repeated whole, small groups are gathered.
    A single window is its own key, so nothing is left undecided, capped or left out.

Texts are compared as UTF-8 (null: empty) and matches never cross them.  Rows are
known by their text, so repeated and null keys are no special case: copies of a
text of ``length`` bytes or more are all removed.  Shorter texts stay as they are.
Where 64-bit hashes stand for anchors, segments or windows, two are always combined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import dropped, in_batches, partitions, sized, spread, stored, texts, values

LENGTH = 200
GRAM = 80
#: Bytes of a block, and the number of segments beyond which an anchor's windows are split.
BLOCK, MANY = 1 << 18, 900
#: Segments of a file of an intermediate table.
EACH = 100_000
RANGES = (16, 4, 1)
_BASE = 0x9E3779B97F4A7C15
_POSITION = 23  # bits for a position in a stretch of a text; the hash has the rest
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes: a polynomial by prefix sums, then mixed."""
    power, inverse = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(b) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM, stretch: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor with its windows.

    Long texts are walked in stretches, which only split an anchor's windows in two.
    """
    parts = []
    for at in range(0, max(0, len(text) - length + 1), stretch):
        b = np.frombuffer(text, dtype=np.uint8, count=min(stretch + length - 1, len(text) - at), offset=at)
        h = gram_hashes(b, gram)
        width = length - gram + 1
        key = (h >> np.uint64(_POSITION)) << np.uint64(_POSITION) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(-1, width)
        before = np.minimum.accumulate(grid, axis=1).reshape(-1)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        n = len(b) - length + 1
        place = (np.minimum(after[:n], before[width - 1 : width - 1 + n]) & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        parts.append((h[place[first]].view(np.int64), place[first] + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_order(block: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` bytes or more (prefix doubling from eight)."""
    n = len(block)
    wide = np.concatenate([block, np.zeros(8, block.dtype)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):  # nine bits each: bytes are moved up by one and 0 ends a segment
        key = (key << np.uint64(9)) | wide[i : i + n]
    order, known = np.argsort(key), 7
    while True:
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        if known >= depth or int(rank[order[-1]]) == n - 1:
            return order
        later = np.zeros(n, dtype=np.uint64)
        later[: n - known] = rank[known:] + np.uint64(1)
        key = (rank << np.uint64(32)) | later
        order, known = np.argsort(key), known * 2


def repeated_neighbours(block: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For j in 1..n-1: whether the suffixes at j - 1 and j of the order share ``length`` symbols.

    Interval expansion: the interval of a string w of l symbols is extended to the
    left by each symbol c before w.  If the right end of cw's interval has no value
    yet, the common prefix there has exactly l symbols, and cw is expanded in the next
    round.  A round walks the rows of its intervals, which are disjoint: the rows that
    one symbol precedes map to an interval of their own, from the first to the last of
    them, so sorted first and last images pair up.
    """
    n = len(block)
    bwt = block[order - 1]  # the text is taken as a circle
    row = np.argsort(bwt, kind="stable")
    image = np.empty(n, dtype=np.int64)
    image[row] = np.arange(n)
    change = bwt[row[1:]] != bwt[row[:-1]]
    before, after = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)  # rows that the same symbol precedes
    before[row[1:]] = np.where(change, -1, row[:-1])
    after[row[:-1]] = np.where(change, n, row[1:])
    unknown = np.ones(n + 1, dtype=bool)
    unknown[0] = unknown[n] = False
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = hi - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        left = np.sort(image[at[before[at] < np.repeat(lo, size)]])
        right = np.sort(image[at[after[at] >= np.repeat(hi, size)]]) + 1
        new = unknown[right]
        if not new.any():
            break
        lo, hi = left[new], right[new]
        unknown[hi] = False
    return unknown[1:n]


def repeated_starts(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the starts of its windows that start elsewhere in the segments too."""
    sizes = np.array([len(s) for s in segments])
    block = np.zeros(int(sizes.sum()) + len(segments), dtype=np.uint16)
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    for a, s in zip(at.tolist(), segments):
        block[a : a + len(s)] = np.frombuffer(s, dtype=np.uint8).astype(np.uint16) + 1
    order = suffix_order(block, length)
    same = repeated_neighbours(block, order, length)
    twice = np.zeros(len(block), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return [np.flatnonzero(twice[a : a + n - length + 1]) if n >= length else np.zeros(0, np.int64) for a, n in zip(at.tolist(), sizes.tolist())]


def runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that windows cover, as (start, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _identity(text: Column) -> tuple[Column, Column]:
    """Two numbers that stand for a text: a 64-bit hash, and its size with a checksum."""
    whole = F.coalesce(text, F.lit("")).cast("binary")
    return F.xxhash64(whole), F.shiftleft(F.octet_length(whole).cast("long"), 32).bitwiseOR(F.crc32(whole))


_BODY = ("h", "tag", "anchor", "seg", "copies", "first", "lead", "body")
_BODY_SCHEMA = "h long, tag long, anchor long, seg long, copies long, first long, lead long, body binary"


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, many: int = MANY) -> DataFrame:
    """``h, tag, spans``: for each text with repeated windows (known by h and tag), spans that together cover them."""
    h, tag = _identity(F.col(text))
    given = docs.select(h.alias("h"), tag.alias("tag"), text).where(F.octet_length(text) >= length)

    def make_segments():
        def each(batch):
            found = []
            for i, t in enumerate(texts(batch, text)):
                a, place, first, last = anchors(t, length)
                view = memoryview(t)
                seg = [xxhash.xxh3_64_intdigest(view[x : y + length]) for x, y in zip(first.tolist(), last.tolist())]
                found.append((np.full(len(a), i), a, np.array(seg, dtype=np.uint64).view(np.int64), first, last, place - first))
            row, a, seg, first, last, lead = (np.concatenate(x) for x in zip(*found))
            for k in range(0, len(row), 1 << 17):
                part = slice(k, k + (1 << 17))
                yield {c: batch.column(batch.schema.get_field_index(c)).take(_arrow(row[part])) for c in ("h", "tag")} | {c: _arrow(x[part]) for c, x in (("anchor", a), ("seg", seg), ("first", first), ("last", last), ("lead", lead))}

        return each

    every = stored(in_batches(given, "h long, tag long, anchor long, seg long, first long, last long, lead long", make_segments), "segments")
    total = every.count()
    again = stored(sized(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), total, EACH), "shared-anchors")
    shared = stored(sized(spread(every, again, ["anchor"], "n", total), total, EACH), "shared-segments")
    dropped(every, again)
    kinds = shared.groupBy("anchor", "seg").agg(F.count("*").alias("copies"), F.min(F.struct("h", "tag", "first", "last", "lead")).alias("at"))
    kinds = stored(sized(kinds, total, EACH), "segment-kinds")
    copied = stored(sized(kinds.where("copies > 1").select("anchor", "seg", "copies"), total, EACH), "copied-segments")
    whole = spread(shared, copied, ["anchor", "seg"], "copies", total).select("h", "tag", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    mixed = _mixed(kinds).select("anchor")
    wanted = kinds.join(mixed, "anchor").select("at.*", "anchor", "seg", "copies")
    listed = wanted.groupBy("h", "tag").agg(F.collect_list(F.struct("anchor", "seg", "copies", "first", "last", "lead")).alias("wanted"))

    def make_bodies():
        def each(batch):
            rows = []
            for x, y, t, given in zip(values(batch, "h"), values(batch, "tag"), texts(batch, text), values(batch, "wanted")):
                rows += [(x, y, w["anchor"], w["seg"], w["copies"], w["first"], w["lead"], t[w["first"] : w["last"] + length]) for w in given]
                if len(rows) > 4096:
                    yield dict(zip(_BODY, map(list, zip(*rows))))
                    rows = []
            if rows:
                yield dict(zip(_BODY, map(list, zip(*rows))))

        return each

    # copies of a text give equal rows; they are made one before bodies are gathered
    bodies = in_batches(given.join(listed, ["h", "tag"]), _BODY_SCHEMA, make_bodies).groupBy("anchor", "seg").agg(*[F.first(c).alias(c) for c in _BODY if c not in ("anchor", "seg")])
    bodies = stored(bodies.select(*_BODY), "segment-bodies")
    found = whole
    for width in RANGES:
        sizes = bodies.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > many).select("anchor")
        sizes = stored(sized(sizes, total, EACH), "large-anchors")
        if sizes.isEmpty():
            break
        found = found.unionByName(_in_blocks(bodies.join(sizes, "anchor", "left_anti"), length))
        parts = stored(_ranges(bodies.join(sizes, "anchor", "left_semi"), width, length), "ranges")
        kinds = stored(parts.groupBy("anchor", "seg").agg(F.sum("copies").alias("copies")), "range-kinds")
        copied = stored(kinds.where("copies > 1").select("anchor", "seg"), "copied-ranges")
        inside = parts.where("copies = 1").join(copied, ["anchor", "seg"])
        found = found.unionByName(inside.select("h", "tag", F.col("first").alias("a"), (F.col("first") + F.octet_length("body")).alias("b")))
        left = _mixed(kinds).select("anchor")
        chosen = parts.drop("copies").join(left, "anchor").join(kinds, ["anchor", "seg"]).groupBy("anchor", "seg").agg(F.first("copies").alias("copies"), *[F.first(c).alias(c) for c in _BODY if c not in ("anchor", "seg", "copies")])
        bodies = stored(chosen.select(*_BODY), "range-bodies")
    else:
        # of single windows, groups with more than one kind cannot be: the key is the whole window
        sizes = None
    if sizes is not None:
        found = found.unionByName(_in_blocks(bodies, length))
    return found.groupBy("h", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _mixed(kinds: DataFrame) -> DataFrame:
    """Anchors with differing segments, of which one at least occurs once."""
    return kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1")


def _ranges(bodies: DataFrame, width: int, length: int) -> DataFrame:
    """Bodies cut to windows whose distances from the anchor fall into one range of ``width``; the new key is what those windows share."""

    def make():
        def each(batch):
            rows = []
            for h, tag, anchor, copies, first, lead, body in zip(*(values(batch, c) for c in ("h", "tag", "anchor", "copies", "first", "lead", "body"))):
                view, n = memoryview(body), len(body) - length + 1
                # window i starts lead - i bytes before the anchor
                for k in range((lead - n + 1) // width, lead // width + 1):
                    i, j = max(0, lead - (k + 1) * width + 1), min(n - 1, lead - k * width)
                    core = view[lead - k * width : lead - (k + 1) * width + 1 + length]
                    rows.append((h, tag, _key(anchor, k, core), _key(anchor, k, view[i : j + length]), copies, first + i, lead - i, body[i : j + length]))
                if len(rows) > 4096:
                    yield dict(zip(_BODY, map(list, zip(*rows))))
                    rows = []
            if rows:
                yield dict(zip(_BODY, map(list, zip(*rows))))

        return each

    return in_batches(bodies.select(*_BODY), _BODY_SCHEMA, make)


def _key(anchor: int, k: int, part) -> int:
    x = xxhash.xxh3_64_intdigest(part, seed=(anchor ^ k * 0x9E3779B1) & ((1 << 64) - 1))
    return x - (1 << 64) if x >> 63 else x


def _arrow(x: np.ndarray):
    import pyarrow as pa

    return pa.array(x)


def _in_blocks(bodies: DataFrame, length: int) -> DataFrame:
    def make():
        waiting: list[tuple] = []
        size = 0

        def flush():
            nonlocal size
            starts = repeated_starts([r[4] for r in waiting], length)
            rows = [(h, tag, first + a, first + b) for (h, tag, copies, first, _), s in zip(waiting, starts) if copies == 1 for a, b in runs(s, length)]
            waiting.clear()
            size = 0
            if rows:
                yield dict(zip(("h", "tag", "a", "b"), map(list, zip(*rows))))

        last = None

        def each(batch):
            nonlocal last, size
            for h, tag, anchor, copies, first, body in zip(*(values(batch, c) for c in ("h", "tag", "anchor", "copies", "first", "body"))):
                if anchor != last and size >= BLOCK:
                    yield from flush()
                waiting.append((h, tag, copies, first, body))
                size += len(body)
                last = anchor

        each.finish = lambda: flush() if waiting else []
        return each

    n = partitions(bodies.sparkSession)
    grouped = bodies.select("h", "tag", "anchor", "copies", "first", "body").repartition(n, "anchor").sortWithinPartitions("anchor")
    return in_batches(grouped, "h long, tag long, a long, b long", make)


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The ``keep`` columns with ``kept`` (the remaining bytes, or if ``decoded`` their whole characters), ``n_bytes, n_removed, n_spans, kept_sha256`` and ``removed`` (start, end of each run)."""
    new = T.StructType.fromDDL(f"kept {'string' if decoded else 'binary'}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>").fields
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    spans = repeated_spans(docs, text, length)
    h, tag = _identity(F.col(text))
    given = docs.select(*dict.fromkeys([*kept, text]), h.alias("_h"), tag.alias("_tag"))
    given = given.join(spans.select(F.col("h").alias("_h"), F.col("tag").alias("_tag"), F.col("spans").alias("_spans")), ["_h", "_tag"], "left")
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in kept), *new])

    def make():
        def each(batch):
            rows = []
            for t, found in zip(texts(batch, text), values(batch, "_spans")):
                gone = merged([(s["a"], s["b"]) for s in found or ()])
                rest, at = [], 0
                for a, b in gone:
                    rest.append(t[at:a])
                    at = b
                rest = b"".join([*rest, t[at:]])
                rows.append((rest.decode("utf-8", "ignore") if decoded else rest, len(t), len(t) - len(rest), len(gone), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            yield {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {f.name: [r[k] for r in rows] for k, f in enumerate(new)}

        return each

    return in_batches(given, schema, make)


def deduplicated(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut from their texts, columns as before.

    A character of which a byte is removed goes whole.  Documents that lose all but
    white space go; an ``n_chars`` column is brought up to date.
    """
    columns = docs.columns
    cut = without_repeats(docs, text, length, decoded=True)
    rest = cut.withColumn(text, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col(text)))
    rest = rest.where((F.col("n_removed") == 0) | (F.trim(text) != ""))
    if "n_chars" in columns:
        rest = rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rest.select(*columns)
