"""SimHash near-duplicates with covering locality-sensitive hashing.

Links between fingerprints at a distance of ``radius`` bits or fewer are found
through 2^(radius+1) - 1 tables, each keyed by the bits under a mask.  Position i
of the fingerprint is given a vector m(i) over GF(2) of radius + 1 bits; the mask
of the table v keeps the positions with <m(i), v> = 1.  Any ``radius`` positions'
vectors leave some v orthogonal to all, so every linked pair agrees on a whole mask:
no link is lost.  In a bucket of at most ``PAIRS`` fingerprints, pairs are compared.
In a larger one each fingerprint instead gives a key for every two positions that
the mask leaves free, with these cleared; equal keys are links, which a star joins.
That is linear in the bucket and exact as well.  Only distinct fingerprints take
part, so copies cost nothing, however many.

Texts: A-Z are lower-cased, words are runs of bytes other than white space, and
shingles are words joined by a space.  A text of fewer words than a shingle has one
shingle; a null, an empty text or white space has none, and fingerprint zero, linked
as any other.  Rows with a null key keep their fingerprint, link others and take
their group's component, but never name one: it is null where all keys are.  Repeated keys share rows' components as
equal nodes.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, stored, texts
from keyloom.llm.graph import components

BITS = 64
#: A bucket of more fingerprints is joined through cleared positions, not pairs.
PAIRS = 48
SEED = 42


def words(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: both know ASCII alone


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    w = words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(size)))) if len(w) >= size else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if over half of the hashes have it; as a signed 64-bit number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks, as unsigned numbers."""
    size = radius + 1
    vectors = [1 + i % ((1 << size) - 1) for i in range(bits)]
    rng = np.random.default_rng(64)
    rng.shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 1 << size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``fp`` (the fingerprint as a signed long) to the ``keep`` columns."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    schema = T.StructType([*(f for f in docs.schema.fields if f.name in kept), T.StructField("fp", T.LongType())])

    def make():
        def each(batch):
            yield {c: batch.column(batch.schema.get_field_index(c)) for c in kept} | {"fp": [fingerprint(shingle_hashes(t, shingle)) for t in texts(batch, text)]}

        return each

    return in_batches(docs.select(*dict.fromkeys([*kept, text])), schema, make)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def links(distinct: DataFrame, radius: int = 2, pairs: int = PAIRS) -> DataFrame:
    """``a, b``: links that join all fingerprints within ``radius`` bits, between the rows' ``node``.

    distinct: ``fp, node`` with each fingerprint once.  For radii other than 2 or 1
    a larger bucket clears as many positions as the radius.
    """
    tables = masks(radius)
    keyed = distinct.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(tables)])).alias("x")).select("fp", "node", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["t", "k"]), "covering")
    few, many = shared.where(F.col("n") <= pairs), shared.where(F.col("n") > pairs)
    near = few.alias("x").join(few.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius))
    near = near.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    cleared = None
    for t, mask in enumerate(tables):
        free = [i for i in range(BITS) if not mask >> i & 1]
        keys = F.array(*[F.lit(_signed((1 << BITS) - 1 - sum(1 << i for i in c))) for c in combinations(free, min(radius, len(free)))])
        part = many.where(F.col("t") == t).select("t", "fp", "node", F.explode(keys).alias("m"))
        cleared = part if cleared is None else cleared.unionByName(part)
    cleared = cleared.select("t", "m", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "node")
    hubs = cleared.groupBy("t", "m", "k").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    star = cleared.join(hubs, ["t", "m", "k"]).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return near.unionByName(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` for every row; the component is the smallest key reachable over links."""
    prints = stored(with_fingerprints(docs.select(*dict.fromkeys([key, text])), shingle, text, keep=[key]), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min(key).alias("least")), "distinct-fingerprints")
    near = links(distinct.select("fp", F.col("fp").alias("node")), radius).select("a", "b")
    hubs = distinct.where("least is not null").groupBy("least").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    found = components(near.unionByName(distinct.join(hubs, "least").select(F.col("fp").alias("a"), "b"))).withColumnRenamed("node", "fp")
    linked = distinct.join(found, "fp", "left")
    ids = linked.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    named = linked.join(ids, "component", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return prints.join(named, "fp").select(key, hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
