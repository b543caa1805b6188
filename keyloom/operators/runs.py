"""Sorted runs: cutting the log, key ranges, blocks, sparse index, overlap, bloom probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyloom.functions.keys import entry_bytes, reserved_bytes
from keyloom.operators.log import running_total
from keyloom.schema import BLOCK_BYTES, MEMTABLE_BYTES
from keyloom.storage import stored


def with_running_bytes(log: DataFrame, edges: bool = False) -> DataFrame:
    """Adds ``bytes`` and ``bytes_before`` (of all earlier versions)."""
    return running_total(log.withColumn("bytes", entry_bytes(F.col("key"), F.col("value"))), "seq", "bytes", "bytes_before", before=True, edges=edges)


def assign_runs(log: DataFrame, budget: int = MEMTABLE_BYTES) -> DataFrame:
    """Adds ``run_id``: a version's run begins anew with each ``budget`` bytes of the log."""
    return with_running_bytes(log).withColumn("run_id", F.floor(F.col("bytes_before") / budget).cast("long"))


def gathered_runs(log: DataFrame, budget: int = MEMTABLE_BYTES) -> DataFrame:
    """``run_id`` and the log's columns as of :func:`assign_runs`, each run whole in one partition and in internal order.

    The log is shuffled once, to add up its bytes.  A run that lies within a bucket of that
    sum is whole there already; only runs across the edges of buckets are shuffled again.
    """
    placed = with_running_bytes(log, edges=True).withColumn("run_id", F.floor(F.col("bytes_before") / budget).cast("long"))
    whole = (F.col("_from") <= F.col("run_id") * budget) & ((F.col("run_id") + 1) * budget <= F.col("_to"))
    whole = F.coalesce(whole, F.lit(False))  # a null key has no bytes and no run
    kept = ["run_id", *log.columns]
    within, across = placed.where(whole).select(kept), placed.where(~whole).select(kept).repartition("run_id")
    return within.unionByName(across).sortWithinPartitions("run_id", "key", F.desc("seq"))


def rotate_exactly(log: DataFrame, budget: int = MEMTABLE_BYTES, width: int = 1 << 16) -> DataFrame:
    """Adds ``run_id`` as a memtable rotates: after the batch that takes it over ``budget`` bytes, counting from zero again.

    Each rotation depends on the one before, so the fold walks batch totals in
    order: ``width`` batches make one array of sums, and one row for each array
    passes through the fold.  The versions themselves are not gathered.
    """
    sums = log.groupBy("batch_id").agg(F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("bytes"), F.min("seq").alias("seq"))
    grouped = sums.groupBy(F.floor(F.col("batch_id") / width).alias("part")).agg(F.array_sort(F.collect_list(F.struct("batch_id", "bytes"))).alias("items"))

    def fold(frames):
        import pandas as pd

        used, run = 0, 0
        for frame in frames:
            for items in frame["items"]:
                ids, runs = [], []
                for item in items:
                    ids.append(item["batch_id"])
                    runs.append(run)
                    used += item["bytes"]
                    if used > budget:
                        used, run = 0, run + 1
                yield pd.DataFrame({"batch_id": ids, "run_id": runs})

    runs = grouped.repartition(1).sortWithinPartitions("part").mapInPandas(fold, "batch_id long, run_id long")
    return log.join(runs, "batch_id")


def run_meta(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Key range, sequence range, count and bytes of each run."""
    return entries.groupBy(*(by or ["run_id"])).agg(
        F.min("key").alias("min_key"),
        F.max("key").alias("max_key"),
        F.min("seq").alias("min_seq"),
        F.max("seq").alias("max_seq"),
        F.count("*").alias("n_entries"),
        F.sum(entry_bytes(F.col("key"), F.col("value"))).alias("data_bytes"),
    )


def newest_per_run(entries: DataFrame) -> DataFrame:
    rest = [c for c in entries.columns if c not in ("run_id", "key")]
    best = entries.groupBy("run_id", "key").agg(F.max_by(F.struct(*rest), "seq").alias("_v"))
    return best.select("run_id", "key", *[F.col(f"_v.{c}").alias(c) for c in rest])


def memtable(entries: DataFrame) -> DataFrame:
    """All versions and tombstones of the newest run, as an iterator gives them."""
    newest = entries.agg(F.max("run_id").alias("run_id"))
    return entries.join(F.broadcast(newest), "run_id", "left_semi").orderBy("key", F.desc("seq"))  # of one row


def overlapping(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """Runs of ``upper`` whose key range meets the range that all runs of ``lower`` span together."""
    span = lower.agg(F.min("min_key").alias("_low"), F.max("max_key").alias("_high"))
    return upper.join(F.broadcast(span), (F.col("min_key") <= F.col("_high")) & (F.col("max_key") >= F.col("_low")), "left_semi")  # of one row


def overlapping_pairs(lower: DataFrame, upper: DataFrame) -> DataFrame:
    """``run_id, with_run_id`` of runs whose ranges meet; run metadata, a row for each file, is small."""
    x, y = lower.alias("x"), upper.alias("y")
    return x.join(y, (F.col("y.min_key") <= F.col("x.max_key")) & (F.col("y.max_key") >= F.col("x.min_key"))).select(F.col("x.run_id").alias("run_id"), F.col("y.run_id").alias("with_run_id"))


def in_key_order(meta: DataFrame) -> DataFrame:
    return meta.orderBy("min_key", "run_id")


def positions(entries: DataFrame, by: str, order: list[Column]) -> DataFrame:
    return entries.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


def sparse_index(entries: DataFrame, per_block: int = 64) -> DataFrame:
    """``run_id, block, min_key, n_entries``: blocks of ``per_block`` entries of each run in internal order."""
    placed = positions(entries, "run_id", [F.col("key").asc(), F.col("seq").desc()]).withColumn("block", F.floor(F.col("position") / per_block).cast("long"))
    return placed.groupBy("run_id", "block").agg(F.min("key").alias("min_key"), F.count("*").alias("n_entries"))


def pack_blocks(entries: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``block``: entries of a run in internal order fill a block while the next one's reservation fits.

    Where a block ends depends on where it began, so each run passes one task in order,
    as a stream of batches: what is held is a running size, however long the run is.
    """
    import pyarrow as pa

    rows = entries.withColumns({"_need": reserved_bytes(F.col("key"), F.col("value")), "_own": entry_bytes(F.col("key"), F.col("value"))})
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "key", F.desc("seq"))
    schema = entries.withColumn("block", F.lit(0).cast("long")).schema

    def fill(batches):
        run, used, block = None, 0, 0
        for batch in batches:
            placed = []
            for of, need, own in zip(*(batch.column(c).to_pylist() for c in ("run_id", "_need", "_own"))):
                if of != run:
                    run, used, block = of, 0, 0
                elif used + need > block_bytes:
                    used, block = 0, block + 1
                used += own
                placed.append(block)
            kept = batch.select([f.name for f in schema if f.name != "block"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(placed, pa.int64())], names=[*kept.schema.names, "block"])

    return ordered.mapInArrow(fill, schema)


def block_ranges(packed: DataFrame) -> DataFrame:
    """``run_id, block, min_key, max_key, n_entries, data_bytes`` of :func:`pack_blocks`."""
    return run_meta(packed, ["run_id", "block"]).select("run_id", "block", "min_key", "max_key", "n_entries", "data_bytes")


#: Key ranges that a floor seek is cut into at least, the keys of a range at most (about), and the keys of a row that meets an index row.
SEEK_RANGES, SEEK_KEYS, SEEK_CHUNK = 64, 1 << 16, 2048


def floor_seek(index: DataFrame, keys: DataFrame, meta: DataFrame | None = None, ranges: int = SEEK_RANGES) -> DataFrame:
    """``key, run_id, min_key``: for each key and run the block to look in, that with the largest least key not above it.

    With ``meta`` (``run_id, max_key``) only runs whose key range holds the key are asked.

    The answer may have a row for each key and run, so it is made where it is used:
    what is shuffled is the keys, the index, and a row for each run and key range.
    Key space is cut into ranges of about as many keys.  In a range, an index row answers
    from its key up to the run's next one, and the last one of earlier ranges up to the
    first; these intervals meet sorted chunks of the range's keys, which are unpacked there.
    Intervals are cut at the edges of chunks and meet them chunk by chunk, in each run by run, so a
    chunk's keys come again and again in the same order: stored, the answer compresses to a fraction
    of what it takes by run.  Spark holds what one interval makes at once, so an interval, not a chunk, is what it goes by.
    """
    spark = index.sparkSession
    index = stored(index.select("run_id", "min_key"), "index")
    kind = index.schema["min_key"].dataType
    wanted = stored(keys.select(F.col("key").cast(kind).alias("key")).where("key is not null").distinct(), "keys")
    n = max(ranges, -(-wanted.count() // SEEK_KEYS))
    dealt = wanted.repartitionByRange(n, "key").sortWithinPartitions("key").withColumn("_id", F.monotonically_increasing_id())
    dealt = stored(dealt.select("key", F.shiftright("_id", 33).alias("_part"), F.floor(F.col("_id").bitwiseAND((1 << 33) - 1) / SEEK_CHUNK).alias("_chunk")), "dealt")
    cuts = sorted(r[0] for r in dealt.groupBy("_part").agg(F.min("key")).select("min(key)").collect())[1:]  # a key for each range
    spread = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else F.array().cast(f"array<{kind.simpleString()}>")
    place = lambda c: F.size(F.filter(spread, lambda cut: cut <= c))
    marks = index.select("run_id", place(F.col("min_key")).alias("_range"), "min_key")
    tops = marks.groupBy("run_id", "_range").agg(F.max("min_key").alias("_top"))
    reach = marks.groupBy("run_id").agg(F.min("_range").alias("_from"))
    if meta is None:
        reach = reach.select("run_id", "_from", F.lit(len(cuts)).alias("_to"), F.lit(None).cast(kind).alias("_max"))
    else:
        reach = reach.join(meta.groupBy("run_id").agg(F.max("max_key").alias("_max")), "run_id").select("run_id", "_from", place(F.col("_max")).alias("_to"), "_max")
    spans = reach.where("_from <= _to").select("run_id", "_max", F.explode(F.sequence("_from", "_to")).alias("_range"))
    before = Window.partitionBy("run_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(tops, ["run_id", "_range"], "left").select("run_id", "_range", F.max("_top").over(before).alias("min_key")).where("min_key is not null")
    following = Window.partitionBy("run_id", "_range").orderBy("min_key")
    held = marks.unionByName(carried).withColumn("_below", F.lead("min_key").over(following)).where("_below is null or _below > min_key")
    held = held.join(reach.select("run_id", "_max"), "run_id").where("_max is null or min_key <= _max")
    chunks = dealt.groupBy("_part", "_chunk").agg(F.sort_array(F.collect_list("key")).alias("_keys"))  # of bounded length
    chunks = chunks.select("_keys", "_chunk", F.element_at("_keys", 1).alias("_low"))
    # one range a task: numbers that hash partitioning sends to a partition each
    numbers = _one_a_partition(spark, len(cuts) + 1)
    task = lambda c: F.element_at(F.array(*map(F.lit, numbers)), c + 1).alias("_task")
    held = held.select("run_id", "min_key", "_below", "_max", task(F.col("_range"))).repartition(len(numbers), "_task")
    bounds = dealt.groupBy("_part", "_chunk").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    bounds = bounds.select(task(place(F.col("low"))), F.struct("low", "high", F.col("_chunk").alias("chunk")).alias("_bounds")).groupBy("_task").agg(F.collect_list("_bounds").alias("_bounds"))
    meet = lambda c: (c["high"] >= F.col("min_key")) & (F.col("_below").isNull() | (c["low"] < F.col("_below"))) & (F.col("_max").isNull() | (c["low"] <= F.col("_max")))
    held = held.join(F.broadcast(bounds), "_task").select("run_id", "min_key", "_below", "_max", "_task", F.explode(F.filter("_bounds", meet)["chunk"]).alias("_in"))  # a row for each range
    held = held.sortWithinPartitions("_task", "_in", "run_id", "min_key").withColumn("_at", F.monotonically_increasing_id())  # used below, else the optimizer drops the order
    chunks = chunks.select("_keys", "_chunk", task(place(F.col("_low")))).repartition(len(numbers), "_task")
    # a difference, so that the chunk is no key of the join, whose sides are dealt by task
    pairs = held.hint("merge").join(chunks, (held["_task"] == chunks["_task"]) & (F.col("_in") - F.col("_chunk") == 0) & (F.col("_at") >= 0))
    unpacked = pairs.select(F.explode("_keys").alias("key"), "run_id", "min_key", "_below", "_max")
    return unpacked.where("key >= min_key and (_below is null or key < _below) and (_max is null or key <= _max)").select("key", "run_id", "min_key")


def _one_a_partition(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning by one of them spreads over all ``n`` partitions."""
    found = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()  # n rows
    spare = iter(range(64 * n, 65 * n))
    by = {r["at"]: r["id"] for r in found}
    return [by[i] if i in by else next(spare) for i in range(n)]


def bloom_positions(key: Column, bits: int, hashes: int = 3) -> list[Column]:
    """Bit positions of a key, from slices of its MD5."""
    digest = F.md5(key.cast("binary"))
    return [F.pmod(F.conv(F.substring(digest, 1 + 7 * i, 7), 16, 10).cast("long"), F.lit(bits)) for i in range(hashes)]


def xx_positions(key: Column, bits: int, hashes: int = 3) -> list[Column]:
    """Bit positions of a key, from seeded hashes; cheaper than MD5."""
    return [F.pmod(F.xxhash64(key.cast("binary"), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def bloom_build(keys: DataFrame, bits: int, hashes: int = 3, positions=bloom_positions) -> DataFrame:
    """``bit``: the set bits, at most ``bits`` rows.  ``positions`` is the hash family."""
    return keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes))).alias("bit")).distinct()


def bloom_words(filter_bits: DataFrame) -> DataFrame:
    """``word, mask``: the set bits packed 32 to a row, as a filter is stored."""
    mask = F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))"))
    return filter_bits.groupBy(F.expr("bit div 32").alias("word")).agg(mask.alias("mask"))


def bloom_bits(words: DataFrame) -> DataFrame:
    """The set bits of :func:`bloom_words`."""
    each = words.select("word", "mask", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    return each.where(F.expr("shiftright(mask, i) & 1") == 1).select((F.col("word") * 32 + F.col("i")).alias("bit"))


def bloom_probe(keys: DataFrame, filter_bits: DataFrame, bits: int, hashes: int = 3, positions=bloom_positions) -> DataFrame:
    """The distinct keys that the filter may contain; never without one that it does."""
    mine = F.array_distinct(F.array(*positions(F.col("key"), bits, hashes)))
    asked = keys.select("key").distinct().select("key", F.explode(mine).alias("bit"))
    return asked.join(filter_bits, "bit").groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") == F.size(mine)).select("key")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the row's number (from 1) in a total order over the whole table, without a single-partition window.

    Rows are range-partitioned, sorted and stored with their partition and place; the
    partitions' sizes, one number each, give the offsets.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id"), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_base") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_base")  # a row for each partition
