"""Classes of documents whose sets of word shingles are similar (Jaccard), on top of SimHash.

Sixty-four bits of SimHash put a similarity of 0.8 some ten bits apart, too far for
covering masks of useful width.  So candidates come from the covering tables (all
pairs within two bits) and, besides, from bands of min-wise hashes, which find a
similarity of 0.8 with a probability of 0.9996.  Every link is then verified on the
shingle sets themselves.

Documents with equal shingle sets are one node, so copies make no pairs.  In a
bucket of at most ``FEW`` nodes, pairs are candidates; in a larger one each node is
compared with the hub, the node nearest to the bitwise majority of the fingerprints.
Nodes that are then outside the bucket's main class are compared with some ``PIVOTS``
members of it, in rounds of more and more; those that are outside to the end are
compared with every member of another class.  Links inside a class are not needed for
the classes, so none is lost.  Candidates whose min-wise sketches (256 of four bits) differ in
more places than a pair of that similarity does with a probability of ``LOST`` are not
verified: they are further apart, but for one such pair in 10^12.  Nor are those whose
sets must be too different, which loses nothing: each shingle flips one of 1,024 bits, so
two sets differ in as many shingles at least as their bits do.

Nulls, empty texts and white space have the empty set, and are copies of one
another.  Of a class the row with the smallest key (then text hash) stays; rows equal
in both are one.  A null key sorts first.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import in_batches, sized, stored, texts
from keyloom.llm.graph import components
from keyloom.llm.simhash import _signed, fingerprint, masks, shingle_hashes

BANDS, ROWS, SKETCH = 20, 5, 256
PARITY = 1024
FEW = 24
#: Members of a large bucket's main class that the nodes outside it are compared with first; sixteen times as many in each further round.
PIVOTS = 32
#: The probability that a pair of just the similarity asked for is dropped by its sketches, not verified.
LOST = 1e-12


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2048)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    a, b = family
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), block):
        x = shingles[i : i + block, None] * a + b
        np.minimum(out, (x ^ (x >> np.uint64(31))).min(0), out=out)
    return out


def parity(shingles: np.ndarray) -> list[int]:
    flips = np.bincount(((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64), minlength=PARITY)
    return np.packbits(flips & 1, bitorder="little").view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """``key, th`` (of the row), ``node`` (of its shingle set), ``fp``, ``sketch`` (four bits of each minimum), ``keys`` (of its buckets, by table), ``size`` of the set and ``parity`` (which of ``PARITY`` bits its shingles flip)."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("th long, node long, fp long, sketch array<long>, keys array<long>, size int, parity array<long>").fields])

    def make():
        family, covering = _family(SKETCH), masks(2)
        places = np.arange(0, 64, 4, dtype=np.uint64)

        def each(batch):
            rows = []
            for t in texts(batch, text):
                h = shingle_hashes(t, shingle)
                fp = fingerprint(h)
                s = np.unique(h)
                low = minima(s, family)
                four = (low * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)
                sketch = np.bitwise_or.reduce(four.reshape(-1, 16) << places, axis=1).view(np.int64).tolist()
                bands = [xxhash.xxh3_64_intdigest(low[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) for i in range(BANDS)]
                rows.append((_signed(xxhash.xxh3_64_intdigest(t)), _signed(xxhash.xxh3_64_intdigest(s.tobytes())), fp, sketch, [*map(_signed, bands), *(fp & _signed(m) for m in covering)], len(s), parity(s)))
            yield {key: batch.column(batch.schema.get_field_index(key))} | {f.name: [r[k] for r in rows] for k, f in enumerate(schema.fields[1:])}

        return each

    return in_batches(docs.select(*dict.fromkeys([key, text])), schema, make)


def shingle_sets(docs: DataFrame, shingle: int, text: str) -> DataFrame:
    """``node, shingles``: the sorted distinct shingle hashes of each text."""

    def make():
        def each(batch):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in texts(batch, text)]
            yield {"node": [_signed(xxhash.xxh3_64_intdigest(s.tobytes())) for s in sets], "shingles": [s.view(np.int64).tolist() for s in sets]}

        return each

    return in_batches(docs.select(text), "node long, shingles array<long>", make)


def _most(least: float) -> int:
    """The least number of places that sketches of sets of that similarity exceed with a probability of at most ``LOST``."""
    p, beyond = (1 - least) * 15 / 16, 0.0
    for n in range(SKETCH, 0, -1):
        beyond += comb(SKETCH, n) * p**n * (1 - p) ** (SKETCH - n)
        if beyond > LOST:
            return n
    return 0


def _plausible(least: float) -> Column:
    """Whether two sketches may come from sets of that similarity."""
    most = _most(least)
    differ = F.lit(0)
    for i in range(SKETCH // 16):
        z = F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])
        z = z.bitwiseOR(F.shiftright(z, 1))
        differ += F.bit_count(z.bitwiseOR(F.shiftright(z, 2)).bitwiseAND(F.lit(0x1111111111111111)))
    size = F.col("x.size") + F.col("y.size")
    apart = F.abs(F.col("x.size") - F.col("y.size"))
    flipped = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITY // 64)), F.lit(0))
    most_apart = size * F.lit((1 - least) / (1 + least)) + 1e-6
    return (apart <= most_apart) & (differ <= most) & (flipped <= most_apart)


def _first_shared() -> Column:
    """Whether no table before this one has the two in one bucket."""
    return F.array_position(F.zip_with("x.keys", "y.keys", lambda a, b: a == b), True) == F.col("x.t") + 1


def _candidates(x: DataFrame, y: DataFrame, least: float, *which: Column) -> DataFrame:
    """Distinct plausible pairs (a < b) within the buckets for which ``which`` holds."""
    which = reduce(Column.__and__, [which[0], _plausible(least), *which[1:]])
    pair = x.alias("x").join(y.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.k") == F.col("y.k")) & which)
    return pair.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def classes(docs: DataFrame, shingle: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text", few: int = FEW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches of all rows, nodes with their smallest (key, text hash) ``p``, ``node, component`` for the nodes that have a link)."""
    rows = stored(sketches(docs, shingle, key, text), "sketches")
    nodes = stored(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "sketch", "keys", "size", "parity")], F.min(F.struct(key, "th")).alias("p")), "nodes")
    keyed = nodes.select("node", F.posexplode("keys").alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, ["t", "k"]).join(nodes.select("node", "fp", "sketch", "size", "parity"), "node")
    shared = stored(sized(shared, nodes.count() * (BANDS + len(masks(2)))), "near-buckets")
    small, large = shared.where(F.col("n") <= few), shared.where(F.col("n") > few)
    majority = large.groupBy("t", "k").agg(F.count("*").alias("m"), *[F.sum(F.shiftright("fp", i).bitwiseAND(1)).alias(f"b{i}") for i in range(64)])
    centre = sum((F.when(F.col(f"b{i}") * 2 > F.col("m"), F.lit(_signed(1 << i))).otherwise(F.lit(0)) for i in range(64)), F.lit(0).cast("long"))
    centres = majority.select("t", "k", centre.alias("centre"))
    hubs = large.join(centres, ["t", "k"]).groupBy("t", "k").agg(F.min(F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))).alias("d"), "node", "sketch", "size", "parity")).alias("hub")).select("t", "k", "hub.*")
    in_large = large.count()
    hubs = stored(sized(hubs, in_large), "hubs")
    pairs = _candidates(small, small, least, F.col("x.node") < F.col("y.node")).unionByName(_candidates(hubs, large, least, F.col("x.node") != F.col("y.node")))
    given = docs.select(F.col(text).alias("_text"), key)
    tried = stored(pairs.distinct(), "near-pairs")
    links = stored(verified(tried, given, nodes, shingle, least, key), "verified")
    found = components(links)
    most, asked = large.agg(F.max("n")).first()[0] or 0, PIVOTS
    outside = None
    while most:
        named = large.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        main = named.groupBy("t", "k", "c").count().groupBy("t", "k").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
        named = stored(sized(named.join(main, ["t", "k"]), in_large), "bucket-components")
        rest, before = named.where("c != main"), outside
        outside = rest.count()
        if not outside:
            break
        last = asked >= most or before is not None and outside > 0.9 * before  # more members hardly help: what is left is alone
        if last:
            apart = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
            keyed_by = nodes.select("node", "keys")  # a pair that shares several buckets is met in one
            more = _candidates(rest.join(keyed_by, "node"), named.join(keyed_by, "node"), least, apart, _first_shared())
        else:
            more = _candidates(rest, named.where((F.col("c") == F.col("main")) & (F.pmod(F.xxhash64("node"), F.col("n")) < asked)), least, F.lit(True))
        more = stored(more.join(tried, ["a", "b"], "left_anti"), "near-pairs")
        new = stored(verified(more, given, nodes, shingle, least, key), "verified")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)
        if last:
            break
        tried, asked = tried.unionByName(more), asked * 16
    return rows, nodes, found


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, shingle: int, least: float, key: str) -> DataFrame:
    """The (stored) pairs of nodes whose shingle sets are at least that similar.  Only texts of such nodes are read again, one for each node."""
    n = pairs.count()
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    places = nodes.join(wanted, "node", "left_semi").select(F.col(f"p.{key}").alias("_key")).distinct()
    texts_of = docs.join(places, docs[key].eqNullSafe(F.col("_key")), "left_semi")
    sets = shingle_sets(texts_of, shingle, "_text").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = stored(sized(sets, 2 * n, 2000), "shingle-sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return sized(both.where(common >= least * (F.size("x") + F.size("y") - common)).select("a", "b"), n, 2000)


def one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: one row of each class, with all columns."""
    rows, nodes, found = classes(docs, shingle, least, key, text)
    named = nodes.select("node", "p").join(found, "node", "left").select("p", F.coalesce("component", "node").alias("component"))
    kept = named.groupBy("component").agg(F.min("p").alias("p"))
    kept = kept.select(F.col(f"p.{key}").alias("_key"), F.col("p.th").alias("_th")).distinct()
    kept = stored(sized(kept, nodes.count()), "kept-documents")
    own = [c for c in docs.columns]
    schema = T.StructType([*docs.schema.fields, T.StructField("_th", T.LongType())])

    def make():
        def each(batch):
            yield {c: batch.column(batch.schema.get_field_index(c)) for c in own} | {"_th": [_signed(xxhash.xxh3_64_intdigest(t)) for t in texts(batch, text)]}

        return each

    marked = in_batches(docs, schema, make)
    chosen = marked.join(kept.withColumnRenamed("_th", "_kept"), marked[key].eqNullSafe(F.col("_key")) & (F.col("_th") == F.col("_kept")), "left_semi")
    repeated = rows.groupBy(key, "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("_key"), F.col("th").alias("_kept"))
    twice = stored(repeated, "repeated-rows")
    if twice.isEmpty():
        return chosen.select(*own)
    again = chosen[key].eqNullSafe(F.col("_key")) & (F.col("_th") == F.col("_kept"))
    return chosen.join(twice, again, "left_anti").select(*own).unionByName(chosen.join(twice, again, "left_semi").dropDuplicates([key, "_th"]).select(*own))
