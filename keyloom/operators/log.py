"""The mutation log: batches, dense sequence numbers, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.schema import FIRST_SEQ

#: Rows of consecutive order that a bucket of a running total holds.
WIDTH = 1 << 16


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = WIDTH, before: bool = False, levels: int = 1, edges: bool = False) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to this one by the integer column ``order`` (without it if ``before``).

    No window over the whole table: rows are bucketed by ``order // width``, and each
    bucket adds up its own rows onto the total of the buckets before.  Those totals are
    ordered in one place with one level, which suits a dense ``order``.  With more
    levels the buckets are bucketed again, so that with three not even the sparsest
    orders bring more than 2^16 rows together (widths of 2^16).  ``order`` must be unique.
    With ``edges`` also ``_from`` and ``_to``, the totals before and after the row's bucket,
    whose rows stay in one partition.
    """
    bucket, part, base = (f"_{n}{levels}" for n in ("bucket", "sum", "base"))
    bucketed = df.withColumn(bucket, F.floor(F.col(order) / width).cast("long"))
    sums = bucketed.groupBy(bucket).agg(F.sum(value).alias(part))
    if levels > 1:
        bases = running_total(sums, bucket, part, base, width, True, levels - 1).select(bucket, base, part)
    else:
        earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        bases = sums.select(bucket, F.coalesce(F.sum(part).over(earlier), F.lit(0)).alias(base), part)
    own = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col(base) + F.sum(value).over(own)
    total = total - F.col(value) if before else total
    placed = bucketed.join(bases, bucket).withColumn(name, total.cast("long"))
    if edges:
        placed = placed.withColumns({"_from": F.col(base), "_to": F.col(base) + F.col(part)})
    return placed.drop(bucket, base, part)


def batch_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id").agg(F.count("*").alias("n_ops"))


def batch_bases(log: DataFrame, first_seq: int = FIRST_SEQ) -> DataFrame:
    """``batch_id, n_ops, base_seq``: the sequence number of each batch's first operation."""
    totals = running_total(batch_sizes(log), "batch_id", "n_ops", "_before", before=True, levels=3)
    return totals.select("batch_id", "n_ops", (F.col("_before") + first_seq).alias("base_seq"))


def assign_sequences(ops: DataFrame, first_seq: int = FIRST_SEQ) -> DataFrame:
    """Adds ``seq`` to rows with ``batch_id`` and ``ord`` (0 .. n-1 in each batch)."""
    return ops.join(batch_bases(ops, first_seq).select("batch_id", "base_seq"), "batch_id").withColumn("seq", F.col("base_seq") + F.col("ord")).drop("base_seq")


def as_batches(log: DataFrame) -> DataFrame:
    """``batch_id, seq, ops``: one row for each batch, its operations in order.  A batch is what one caller built, so it is bounded."""
    ops = F.array_sort(F.collect_list(F.struct("ord", "kind", "key", "value")))
    return log.groupBy("batch_id").agg(F.min("seq").alias("seq"), ops.alias("ops"))


def explode_batches(batches: DataFrame) -> DataFrame:
    """The log of :func:`as_batches`, sequence numbers counted from each batch's base."""
    rows = batches.select("batch_id", "seq", F.posexplode("ops").alias("pos", "op"))
    return rows.select("batch_id", F.col("op.ord").alias("ord"), (F.col("seq") + F.col("pos")).alias("seq"), "op.kind", "op.key", "op.value")


def strict_duplicates(log: DataFrame) -> DataFrame:
    """``key, seq, kind, n`` of versions that occur more than once, which no memtable takes."""
    return log.groupBy("key", "seq", "kind").agg(F.count("*").alias("n")).where("n > 1")


def replayed(*logs: DataFrame) -> DataFrame:
    """Logs replayed one after another: a version that comes again changes nothing."""
    out = logs[0]
    for one in logs[1:]:
        out = out.unionByName(one)
    return out.dropDuplicates(["key", "seq", "kind"])


def encoded_batches(batches: DataFrame) -> DataFrame:
    """``batch_id, raw``: the byte form of each batch of :func:`as_batches`."""
    import pyarrow as pa

    from keyloom.functions.codec import Batch

    def encode(frames):
        for frame in frames:
            raw = []
            for seq, ops in zip(frame.column("seq").to_pylist(), frame.column("ops").to_pylist()):
                batch = Batch(seq=seq)
                for op in ops:
                    batch._add(op["kind"], op["key"], op["value"])
                raw.append(batch.encode())
            yield pa.RecordBatch.from_arrays([frame.column("batch_id"), pa.array(raw, pa.binary())], names=["batch_id", "raw"])

    return batches.select("batch_id", "seq", "ops").mapInArrow(encode, "batch_id bigint, raw binary")
