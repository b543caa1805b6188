"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's token ids are counted into a signed hashed vector, which a fixed
random matrix projects to four dimensions; normal quantiles of those become a
Hilbert key.  Documents are sorted by key in range buckets whose bounds are
approximate quantiles, so that a bucket holds a bounded share even where a third
of the documents have one key (bits of the id's hash follow the key).  Buckets and
tasks are as many as the ids' bytes ask for.  The
buckets' token counts give each document its place in one long stream, which is
cut every ``length`` tokens: only the very last sequence can be short.

A null or empty text is the end token alone.  Repeated rows are packed as often
as they occur.  An empty table gives no piece.  No text is cut before it is
tokenised, and only a count for each bucket reaches the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache
from itertools import accumulate
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, partitions, stored, values

HASHED, DIMENSIONS, BITS, TIE_BITS = 256, 4, 10, 23
#: Bytes of ids that a task packs, about; a bucket has an eighth of that.
TASK_BYTES = 64 << 20
#: Quantiles that are asked for at once, of the whole and then of each of its parts.
QUANTILES = 1000
#: Texts with anything else, with white space after a space, or with a run of line ends (of which very
#: long ones overflow the other library's stack), take the tokenizer's own way.
_PLAIN = re.compile("\n{64}|[^\n\x20-\x7e\xa1-\xac\xae-ɏͰ-ͳͶ-ͷΑ-ΡΣ-ϿЀ-ҁҊ-ӿ]| [ \n]")


class Encoder:
    """Byte-level BPE ids of whole texts.

    ``ranks`` and ``pattern`` are the same vocabulary in the other library's form, which
    is several times as fast and agrees on texts without ``_PLAIN``'s exceptions; those,
    and all texts where no ranks are given, take the tokenizer's own way.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 0x10000 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        return np.array(self.fast.encode_ordinary(text), dtype=self.dtype).tobytes()


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(tokenizer, ranks, pattern)


@lru_cache(maxsize=2)
def _hashing(vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and sign of each id in the hashed vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, HASHED, vocabulary), rng.choice([-1.0, 1.0], vocabulary)


def project(vectors: np.ndarray) -> np.ndarray:
    """Hashed vectors to grid cells: DIMENSIONS numbers of BITS bits."""
    r = np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS))
    y = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)) @ r
    edges = np.array([NormalDist().inv_cdf(i / (1 << BITS)) for i in range(1, 1 << BITS)])
    return np.searchsorted(edges, y).astype(np.uint32)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The index along the Hilbert curve of each row of cell numbers (Skilling's transform)."""
    x = cells.T.astype(np.uint32).copy()
    n = len(x)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            on = (x[i] & q) > 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ np.uint32(q - 1), t)
        q >>= np.uint32(1)
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> np.uint32(b)) & np.uint32(1)).astype(np.int64)
    return out


def tokenised(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str | None, end_id: int, key: str, text: str) -> DataFrame:
    """``key, doc_tokens, ids, curve`` for each document."""
    schema = T.StructType([docs.schema[key], T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("curve", T.LongType())])

    def make():
        enc = encoder(tokenizer, ranks, pattern)
        cell, sign = _hashing(max(1 << 16, enc.tokenizer.get_vocab_size()))
        end = np.array([end_id], dtype=enc.dtype).tobytes()

        def each(batch):
            out = [enc.ids(t or "") + end for t in values(batch, text)]
            vectors = np.zeros((len(out), HASHED))
            counts = []
            for i, raw in enumerate(out):
                ids = np.frombuffer(raw, dtype=enc.dtype)
                counts.append(len(ids))
                vectors[i] = np.bincount(cell[ids], weights=sign[ids], minlength=HASHED)
            yield {key: batch.column(batch.schema.get_field_index(key)), "doc_tokens": counts, "ids": out, "curve": hilbert(project(vectors)).tolist()}

        return each

    return in_batches(docs.select(*dict.fromkeys([key, text])), schema, make)


def _bucket(spark: SparkSession, bounds: np.ndarray):
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("long")
    def bucket(curve: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(shared.value, curve.to_numpy(zero_copy_only=False), side="right").astype(np.int64))

    return bucket


def _bounds(rows: DataFrame, buckets: int) -> np.ndarray:
    """Approximate quantiles of ``curve``; beyond ``QUANTILES`` buckets those of each of as many parts."""
    shares = lambda n: [i / n for i in range(1, n)]
    coarse, fine = min(buckets, QUANTILES), -(-buckets // QUANTILES)
    first = rows.select(F.percentile_approx("curve", shares(coarse), 20 * coarse)).first()[0] if coarse > 1 else []
    bounds = np.unique(np.array(first or [], dtype=np.int64))
    if fine > 1:
        parts = rows.groupBy(_bucket(rows.sparkSession, bounds)("curve").alias("part")).agg(F.percentile_approx("curve", shares(fine), 20 * fine).alias("more"))
        bounds = np.unique(np.concatenate([bounds, *(np.array(r.more, dtype=np.int64) for r in parts.select("more").collect())]))
    return bounds


def pack(
    docs: DataFrame,
    tokenizer: str,
    ranks: str | None = None,
    pattern: str | None = None,
    length: int = 2048,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, the ``ids``."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = tokenised(docs, tokenizer, ranks, pattern, end_id, key, text)
    place = F.shiftleft("curve", TIE_BITS) + F.xxhash64(F.col(key), F.crc32("ids")).bitwiseAND((1 << TIE_BITS) - 1)
    rows = stored(rows.withColumn("curve", place), "packing-ids")
    size = 2 if rows_dtype(tokenizer) == "<u2" else 4
    held = size * (rows.agg(F.sum("doc_tokens")).first()[0] or 0)
    n = max(n, -(-held // TASK_BYTES))
    bounds = _bounds(rows, 8 * n)
    placed = rows.withColumn("bucket", _bucket(spark, bounds)("curve"))  # fewer than eight for each task
    totals = dict(placed.groupBy("bucket").agg(F.sum("doc_tokens")).collect())
    order = sorted(totals)
    base = dict(zip(order, accumulate((totals[b] for b in order), initial=0)))
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])
    names = [f.name for f in schema.fields[1:]]

    def make():
        at: dict[int, int] = {}

        def each(batch):
            taken, out = [], []
            for i, (b, raw) in enumerate(zip(values(batch, "bucket"), values(batch, "ids"))):
                ids = np.frombuffer(raw, dtype=f"<u{size}").astype("<u4")
                place = base[b] + at.get(b, 0)
                at[b] = at.get(b, 0) + len(ids)
                start = 0
                while start < len(ids):
                    offset = place % length
                    piece = ids[start : start + length - offset]
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), place // length, offset, *([piece.tolist()] if with_ids else [])))
                    taken.append(i)
                    start += len(piece)
                    place += len(piece)
            yield {key: batch.column(batch.schema.get_field_index(key)).take(taken)} | {c: [r[k] for r in out] for k, c in enumerate(names)}

        return each

    ordered = placed.select(key, "bucket", "curve", "ids").repartition(n, "bucket").sortWithinPartitions("bucket", "curve", key, F.crc32("ids"))
    return in_batches(ordered.select(key, "bucket", "ids"), schema, make)


def rows_dtype(tokenizer: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 0x10000 else "<u4"
