"""Runs as Parquet sorted by key, write-ahead logs as framed batches, and unreferenced files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keyloom.functions.codec import Batch, frames, records
from keyloom.functions.keys import log_number
from keyloom.schema import ENTRY, LOG


#: A filter of a few hundred bytes is the smallest that helps.
LEAST_KEYS = 64


def runs_folder(path: str) -> str:
    return f"{path}/runs"


def run_path(path: str, run_id: int) -> str:
    return f"{runs_folder(path)}/run_id={run_id}"


def run_number(name: str) -> int | None:
    """The number in a run's folder name, or null for other names."""
    digits = name.removeprefix("run_id=")
    return int(digits) if digits != name and digits.isdigit() else None


def _writer(ordered: DataFrame, keys: int):
    """With a bloom filter on the key that has room for ``keys`` of them a file."""
    return ordered.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(LEAST_KEYS, keys)))


def write_run(entries: DataFrame, path: str, run_id: int, keys: int, files: int | None = None) -> None:
    """One run, sorted by key and newest first, so that row groups can be skipped.

    ``keys`` is the run's number of entries.  Ranges are cut by key and sequence, so the
    versions of one key may fill several files.
    """
    n = files or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("seq").desc()]
    rows = entries.select("key", "seq", "kind", "value")
    ordered = (rows.coalesce(1) if n == 1 else rows.repartitionByRange(n, *order)).sortWithinPartitions(*order)
    _writer(ordered, -(-keys // n)).mode("overwrite").parquet(run_path(path, run_id))


def write_runs(entries: DataFrame, path: str, keys: int) -> None:
    """All runs that the column ``run_id`` names, in one job; each run is one sorted file.

    Their folders must not exist.  A run is bounded by the size at which memtables
    rotate or compactions cut.  ``keys`` is the number of entries a run.  Tasks move
    their files to their places themselves (version 2), not the driver one by one: no
    manifest names a run before the job has ended.
    """
    ordered = entries.select("run_id", "key", "seq", "kind", "value").repartition("run_id").sortWithinPartitions("run_id", "key", F.desc("seq"))
    _writer(ordered, keys).option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("append").partitionBy("run_id").parquet(runs_folder(path))


def write_packed(entries: DataFrame, path: str) -> None:
    """Small runs, a file for each task instead of each run, with ``run_id`` as a column.

    ``entries`` has each run whole in one partition and in order, so runs follow one another
    in a file, and the ranges of row groups and pages tell where a run lies.  A file for each run of
    a few KB would take more for its folder, checksum and rounding than for its entries.
    """
    entries.select("key", "seq", "kind", "value", "run_id").write.parquet(runs_folder(path))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ENTRY}, run_id bigint").parquet(runs_folder(path))


def read_runs(spark: SparkSession, path: str, runs: list[int]) -> DataFrame:
    """Entries of the runs, with ``run_id``, in one scan."""
    if not runs:
        return spark.createDataFrame([], f"{ENTRY}, run_id bigint")
    listing, most = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    usual = spark.conf.get(listing)
    spark.conf.set(listing, min(int(usual), most))  # else a task for each run
    try:
        return spark.read.schema(f"{ENTRY}, run_id bigint").option("basePath", runs_folder(path)).parquet(*[run_path(path, r) for r in runs])
    finally:
        spark.conf.set(listing, usual)


def write_wal(batches: DataFrame, folder: str) -> DataFrame:
    """Writes ``number, batch_id, seq, ops`` (see :func:`keyloom.operators.log.as_batches`) as ``<number>.log`` files; returns ``name, n_batches``.

    A task that is run again writes the same bytes under the same name, and each file
    appears whole.  The caller numbers batches so that a file holds what a memtable does.
    """
    from urllib.parse import urlparse

    target = folder if urlparse(folder).scheme else f"file://{folder}"

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(target)
        system.create_dir(where, recursive=True)
        name = f"{int(frame['number'].iloc[0]):09d}.log"
        encoded = []
        for _, row in frame.sort_values("batch_id").iterrows():
            batch = Batch(seq=int(row["seq"]))
            for op in row["ops"]:
                batch._add(op["kind"], bytes(op["key"]), None if op["value"] is None else bytes(op["value"]))
            encoded.append(batch.encode())
        part = f"{where}/{name}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(frames(encoded))
        system.move(part, f"{where}/{name}")
        return pd.DataFrame({"name": [name], "n_batches": [len(encoded)]})

    return batches.groupBy("number").applyInPandas(write, "name string, n_batches long")


def read_wal(spark: SparkSession, folder: str, since: int = 0) -> DataFrame:
    """The log of ``<number>.log`` files in order of number, from ``since`` on; empty files are valid.

    ``batch_id`` is the batch's base sequence number.  A log file is bounded by the
    memtable's budget, so each is decoded whole.
    """
    schema = to_arrow_schema(StructType.fromDDL(LOG))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder).withColumn("number", log_number(F.col("path"))).where(F.col("number") >= since)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = []
                for one in records(raw):
                    b = Batch.decode(one)
                    rows += [(b.seq, i, seq, kind, key, value) for i, (kind, seq, key, value) in enumerate(b)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=pa.schema([pa.field(f.name, f.type) for f in schema]))

    return files.select("content").mapInArrow(decode, LOG)


def dead_files(present: DataFrame, referenced: DataFrame, name: str = "name") -> DataFrame:
    return present.join(referenced.select(name), name, "left_anti")
