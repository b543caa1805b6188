"""Reads: the newest version of each key, single and many keys, history, earlier states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.schema import DELETE, SET


def latest(versions: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """One row for each key: its newest version, whatever its kind.

    The newest is the largest struct, which is combined before the shuffle, so a key
    with very many versions sends one row from each task.
    """
    rest = [c for c in versions.columns if c not in (key, seq)]
    best = versions.groupBy(key).agg(F.max_by(F.struct(seq, *rest), seq).alias("_v"))
    return best.select(key, *[F.col(f"_v.{c}").alias(c) for c in (seq, *rest)]).select(*versions.columns)


def current_state(versions: DataFrame) -> DataFrame:
    return latest(versions).where(F.col("kind") == SET)


def tombstones(versions: DataFrame) -> DataFrame:
    return latest(versions).where(F.col("kind") == DELETE)


def raw_get(versions: DataFrame, key) -> DataFrame:
    """The newest version of one key, a tombstone too; at most one row.  On stored runs the filter reaches the scan."""
    return versions.where(F.col("key") == key).orderBy(F.desc("seq")).limit(1)


def get(versions: DataFrame, key) -> DataFrame:
    """Like :func:`raw_get`, but a deleted key has no row."""
    return raw_get(versions, key).where(F.col("kind") == SET)


def multi_get(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, found, seq, value`` for every row of ``keys``.  Versions of other keys are dropped before they are grouped."""
    wanted = keys.select("key").distinct()
    live = current_state(versions.join(wanted, "key", "left_semi")).select("key", "seq", "value")
    return keys.select("key").join(live, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "seq", "value")


#: Versions of a key beyond which its history is ordered in several tasks.
HOT_VERSIONS = 1 << 20


def history(versions: DataFrame, hot: int = HOT_VERSIONS) -> DataFrame:
    """Each version with ``next_seq``, where its validity ends (null: it is the newest), and ``age`` (0: newest).

    Each key is ordered once.  A key of more than ``hot`` versions is cut into ranges of
    as many sequence numbers, each ordered by itself; the ranges' counts and first
    numbers, a row for each, carry over from one to the next.  A key's sequence numbers
    are distinct.
    """
    counted = versions.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("key", F.lit(True).alias("_hot"))
    cut = versions.join(counted, "key", "left").withColumn("_range", F.when(F.col("_hot"), F.floor(F.col("seq") / hot)).otherwise(0).cast("long")).drop("_hot")
    own = Window.partitionBy("key", "_range").orderBy(F.desc("seq"))
    placed = cut.withColumns({"next_seq": F.lag("seq").over(own), "age": F.row_number().over(own) - 1})
    later = Window.partitionBy("key").orderBy(F.desc("_range"))
    ranges = cut.join(counted.select("key"), "key", "left_semi").groupBy("key", "_range").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    ranges = ranges.select("key", "_range", F.lag("_first").over(later).alias("_next"), F.sum("_n").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    joined = placed.join(ranges, ["key", "_range"], "left")
    return joined.withColumns({"next_seq": F.coalesce("next_seq", "_next"), "age": (F.col("age") + F.coalesce("_later", F.lit(0))).cast("long")}).drop("_range", "_next", "_later")


def as_of(versions: DataFrame, seq: int) -> DataFrame:
    """The live state after the operation ``seq``."""
    return current_state(versions.where(F.col("seq") <= seq))


def prefix_scan(versions: DataFrame, prefix: str | bytes) -> DataFrame:
    """Live keys that begin with ``prefix``; as a range too, since scans take ranges of binary keys and no prefixes."""
    found = F.col("key").startswith(F.lit(prefix))
    if isinstance(prefix, bytes):
        found &= F.col("key") >= F.lit(prefix)
        stem = prefix.rstrip(b"\xff")
        if stem:
            found &= F.col("key") < F.lit(stem[:-1] + bytes((stem[-1] + 1,)))
    return current_state(versions.where(found))


def range_scan(versions: DataFrame, low, high) -> DataFrame:
    """Live keys with low <= key < high."""
    return current_state(versions.where((F.col("key") >= low) & (F.col("key") < high)))
