"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to ``floor(max_error * m)`` edits.
Cut into one piece more than that, some piece of it must occur unchanged; all
items' pieces are looked up in a document at once with an Aho-Corasick automaton.
A hit proposes a window; Myers' bit-parallel algorithm finds the least edit
distance of the item to any substring of it.

Both sides are lower-cased and white-space runs become one space.  An item of null or
empty text matches nothing, one of null id as any other: the id of its matches is null,
and given only if the same text has no id.  A null or empty document has no match; repeated
documents and items match alike.  The items are held by every task in blocks of bounded bytes,
one pass over the documents for each block; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, values


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, max_error: float) -> int:
    return int(max_error * length)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of like length."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of the text, the first end of such a one)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], max_error: float):
        """items: (number, normalised text), no empty texts."""
        self.items = dict(items)
        self.errors = {i: budget(len(t), max_error) for i, t in items}
        places: dict[str, list[tuple[int, int]]] = {}
        for i, t in items:
            for at, piece in pieces(t, self.errors[i]):
                places.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.reversed = {i: t[::-1] for i, t in items}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best occurrence of each item, the leftmost of equals."""
        if not self.items or not text:
            return []
        hits: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            first = last + 1 - size
            for i, at in where:
                hits.setdefault(i, set()).add(first - at)
        found = []
        for i, starts in hits.items():
            item, k = self.items[i], self.errors[i]
            exact = text.find(item)
            if exact >= 0:
                found.append((i, 0, exact, exact + len(item)))
                continue
            if not k:
                continue
            best = (k + 1, 0, 0)
            for lo, hi in _windows(sorted(starts), len(item), k, len(text)):
                distance, end = myers(item, text[lo:hi])
                if distance < best[0]:
                    best = (distance, lo, lo + end)
            if best[0] <= k:
                distance, lo, end = best
                lo = max(lo, end - len(item) - k)
                found.append((i, distance, end - myers(self.reversed[i], text[lo:end][::-1])[1], end))
        return sorted(found)


def _windows(starts: list[int], length: int, k: int, size: int) -> Iterator[tuple[int, int]]:
    """Windows around the proposed starts; near ones are one."""
    lo, last = starts[0], starts[0]
    for s in starts[1:]:
        if s > last + 2 * k:
            yield max(0, lo - k), min(size, last + length + k)
            lo = s
        last = s
    yield max(0, lo - k), min(size, last + length + k)


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of at most ``block_bytes`` (or one item); they reach the driver a partition at a time."""
    block, size = [], 0
    given = benchmark.where(F.col(text).isNotNull()).select(item, text).distinct()
    named, nameless = given.where(F.col(item).isNotNull()), given.where(F.col(item).isNull())
    for row in named.unionByName(nameless.join(named.select(text), text, "left_anti").select(item, text)).toLocalIterator():
        t = normalised(row[1])
        if not t:
            continue
        if block and size + 4 * len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], t))
        size += 4 * len(t)
    if block:
        yield block


def matches(
    docs: DataFrame, benchmark: DataFrame, max_error: float = 0.05, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20
) -> DataFrame:
    """``key, item, distance, start, end`` for each document and each item that occurs in it within its budget.

    ``start`` and ``end`` are of the best occurrence in the normalised document.
    """
    schema = T.StructType([docs.schema[key], T.StructField(item, T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    names = [f.name for f in schema.fields[1:]]
    given = docs.select(*dict.fromkeys([key, text]))
    out = None
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_bytes

        def make(shared=shared):
            matcher = Matcher(list(enumerate(t for _, t in shared.value)), max_error)
            ids = [i for i, _ in shared.value]

            def each(batch):
                taken, rows = [], []
                for i, t in enumerate(values(batch, text)):
                    for n, distance, a, b in matcher.find(normalised(t)):
                        rows.append((ids[n], distance, a, b))
                        taken.append(i)
                if rows:
                    yield {key: batch.column(batch.schema.get_field_index(key)).take(taken)} | {c: [r[k] for r in rows] for k, c in enumerate(names)}

            return each

        part = in_batches(given, schema, make)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_matches(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.05, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The documents in which no item occurs, with their columns; nothing is shuffled."""
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most block_bytes

        def make(shared=shared):
            matcher = Matcher(list(enumerate(t for _, t in shared.value)), max_error)

            def each(batch):
                clean = [not matcher.find(normalised(t)) for t in values(batch, text)]
                kept = batch.filter(pa.array(clean))
                yield {f.name: kept.column(k) for k, f in enumerate(batch.schema)}

            return each

        docs = in_batches(docs, docs.schema, make)
    return docs
