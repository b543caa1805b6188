"""Merging runs and levels, and cutting merged output into new runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.keys import entry_bytes
from keyloom.operators.log import running_total
from keyloom.operators.runs import ranked
from keyloom.operators.state import latest
from keyloom.schema import RUN_BYTES, SET


def merge_runs(*runs: DataFrame) -> DataFrame:
    """One row for each key of any run, the newest version; tombstones stay."""
    return latest(reduce(DataFrame.unionByName, runs))


def merge_levels(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Two sides with one row for each key: the newer side wins where both have it."""
    cols = [c for c in newer.columns if c != "key"]
    n, o = (side.select("key", F.struct(*cols).alias(name)) for side, name in ((newer, "_n"), (older, "_o")))
    return n.join(o, "key", "full_outer").select("key", *[F.coalesce("_n", "_o")[c].alias(c) for c in cols])


def by_precedence(entries: DataFrame) -> DataFrame:
    """The version that a lookup meets first: the lowest level, then the newest run, then the newest version.

    Where no older version lies above a newer one, that is the newest version.
    """
    rest = [c for c in entries.columns if c != "key"]
    rank = F.struct((-F.col("level")).alias("l"), "run_id", "seq")
    best = entries.groupBy("key").agg(F.max_by(F.struct(*rest), rank).alias("_v"))
    return best.select("key", *[F.col(f"_v.{c}").alias(c) for c in rest])


def without_tombstones(merged: DataFrame) -> DataFrame:
    """For the last level alone, where nothing older can come back."""
    return merged.where(F.col("kind") == SET)


def split_runs(merged: DataFrame, target: int = RUN_BYTES, first_run: int = 0) -> DataFrame:
    """Adds ``run_id``: in key order, a new run begins with each ``target`` bytes.

    Ranks come from a range partitioning, and the running total from buckets of ranks.
    """
    order: list[Column] = [F.col("key").asc(), F.col("seq").desc()]
    sized = ranked(merged, order, "_rank").withColumn("_bytes", entry_bytes(F.col("key"), F.col("value")))
    total = running_total(sized, "_rank", "_bytes", "_before", before=True)
    return total.withColumn("run_id", (F.floor(F.col("_before") / target) + first_run).cast("long")).drop("_rank", "_bytes", "_before")
