"""The folder that driver and executors share, and small files in it."""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder only where driver and executors are one process."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="keyloom-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str, unchanged_for: float = 0) -> list[str]:
    """Names in a folder; with ``unchanged_for``, only what was last changed at least so many seconds ago."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    before = time.time() - unchanged_for
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if not unchanged_for or s.getModificationTime() / 1000 <= before)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a new file under another name and renames it, so readers see all of it or nothing.  Fails if it exists."""
    fs, p = file_system(spark, path)
    _, part = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    out.write(bytearray(data))
    out.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:
            continue  # the session has gone; the folder's owner cleans it
