"""Helpers shared by the corpus operators: Arrow maps in bounded parts, texts as bytes, bounded samples."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keyloom.storage import new_path, remove, stored  # noqa: F401  the operators take them from here

#: Rows of an Arrow batch, and bytes unless one row has more.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
_BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def dropped(*tables: DataFrame) -> None:
    """Removes what :func:`stored` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sized(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """``df``, known to have at most ``rows`` rows, in no more partitions than those ask for (eight at least).

    A shuffle's partitions follow its setting; small tables that are written again and
    again would otherwise be as many files as that.  More rows than that are left as they are.
    """
    return df.coalesce(max(8, -(-rows // each)))


def in_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict[str, list]]]]) -> DataFrame:
    """Runs ``make()(batch)`` over Arrow batches; each yielded dict of columns becomes a batch.

    ``make`` is called once for each task, so models and compressors are built there.
    A batch has at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes.  Spark reads its
    settings for that when the plan is run, so the session's are lowered, if they are
    higher, and stay so: larger batches take more memory than an executor may have.
    """
    conf = df.sparkSession.conf
    for name, most in _BOUNDS.items():
        if _number(conf.get(name)) > most or _number(conf.get(name)) <= 0:
            conf.set(name, str(most))
    fields = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for part in _parts(batch):
                for out in each(part):
                    yield _batch(out, fields)
        for out in getattr(each, "finish", list)():
            yield _batch(out, fields)

    return df.mapInArrow(run, schema)


def _number(setting: str) -> int:
    return int(setting.rstrip("bB"))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    waiting = [batch] if batch.num_rows else []
    while waiting:
        part = waiting.pop()
        if part.num_rows > 1 and (part.num_rows > BATCH_ROWS or part.nbytes > BATCH_BYTES):
            half = min(BATCH_ROWS, part.num_rows // 2) if part.nbytes <= BATCH_BYTES else part.num_rows // 2
            waiting += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def _batch(out: dict[str, list], fields: pa.Schema) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) and x.type == f.type else x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in fields)]
    return pa.RecordBatch.from_arrays(arrays, schema=pa.schema([pa.field(f.name, f.type) for f in fields]))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """True for the rows that no model learns from; a null key is held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == 0, F.lit(True))


def lowest(df: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """Rows of the ``most`` keys of each group that hash lowest; rows of one key stay together, and a null group or key has none.

    Two scans, however many groups.  The first counts keys, so that the second passes on
    only hashes below what about twice ``most`` keys have; those alone are shuffled and ranked.
    """
    given = df.where(F.col(by).isNotNull() & F.col(key).isNotNull())
    sizes = stored(given.groupBy(by).agg(F.approx_count_distinct(key).alias("_keys")), "group-sizes")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    near = given.join(sizes, by).where(place * F.col("_keys") < F.lit((2 * most + 64) * (1 << 30)))
    ranked = near.withColumn("_rank", F.dense_rank().over(Window.partitionBy(by).orderBy(place, F.xxhash64(key), F.col(key))))
    return ranked.where(F.col("_rank") <= most).drop("_keys", "_rank")


#: Hot keys that there may be for each partition.
_HOT = 8


def spread(large: DataFrame, small: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``large`` joined to ``small`` on ``on``, the rows of hot keys dealt to all tasks; both are stored tables.

    small has each key once, with the count ``n`` of its rows in ``large``, whose rows are
    ``total``.  A key is hot if it has more than an eighth of a partition's even share of
    rows; so there are at most eight for each partition, which bounds what is broadcast
    and how often a row of ``small`` is repeated.
    """
    parts = partitions(large.sparkSession)
    hot = small.where(F.col(n) > max(1, total // (_HOT * parts))).select(*on, F.lit(True).alias("_hot"))
    rest = small.drop(n)
    if hot.isEmpty():
        return large.join(rest, on)
    hot = F.broadcast(hot)  # at most _HOT keys a partition
    dealt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*large.columns), F.lit(parts))).otherwise(F.lit(0))
    repeated = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = large.join(hot, on, "left").withColumn("_part", dealt.cast("int")).drop("_hot")
    right = rest.join(hot, on, "left").withColumn("_part", F.explode(repeated)).drop("_hot")
    return left.join(right, [*on, "_part"]).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
