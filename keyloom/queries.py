"""Registered queries of the engine over the driver's tables, each with its SQL.

``events`` is the canonical mutation log: a key for each user, a deletion for each
error, ten operations a batch.  ``orders`` is an upsert log by customer, and
``lineitem`` the large log, by part.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions import keys
from keyloom.operators import log as logs
from keyloom.operators import merge, runs, state
from keyloom.plans import compaction
from keyloom.schema import CACHE_SECONDS
from keyloom.sources.files import dead_files as unreferenced
from keyloom.storage import new_path, stored
from keyloom.streaming import ingest

#: Budgets that cut the driver's small tables into several runs.
RUN_BUDGET, SPLIT_BYTES, LEVEL_BASE, PER_BLOCK, BLOOM_BITS = 1 << 14, 1 << 12, 40_000, 64, 4096
LOOKUPS = {"live": "user.7", "missing": "user.none"}

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_log(table(spark, sf_dir, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    error = F.col("event_type") == "error"
    return events.select(
        F.expr("event_id div 10").alias("batch_id"),
        (F.col("event_id") % 10).alias("ord"),
        (F.col("event_id") + 2).alias("seq"),
        F.when(error, 1).otherwise(0).cast("long").alias("kind"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"),
        F.when(~error, F.col("props")).alias("value"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.assign_runs(event_log(spark, sf_dir), RUN_BUDGET).select("run_id", "key", "seq", "kind", "value")


def event_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the runs a level, the newest in level 0, the oldest in level 3; stored, as runs are."""
    entries = stored(event_runs(spark, sf_dir), "levels")
    newest = entries.agg(F.max("run_id")).first()[0] or 0
    return entries.withColumn("level", F.floor((newest - F.col("run_id")) * 4 / (newest + 1)).cast("long"))


def metadata(levels: DataFrame) -> DataFrame:
    return runs.run_meta(levels, ["level", "run_id"])


def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(event_levels(spark, sf_dir))


LOG = """log AS (
    SELECT event_id // 10 AS batch_id, event_id % 10 AS ord, event_id + 2 AS seq,
           CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS kind,
           'user.' || user_id AS key, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value
    FROM events)"""
SIZED = LOG + """, sized AS (
    SELECT *, CAST(strlen(key) + 8 + coalesce(strlen(value), 0) AS BIGINT) AS bytes FROM log)"""
RUNS = SIZED + f""", entries AS (
    SELECT CAST((sum(bytes) OVER (ORDER BY seq) - bytes) // {RUN_BUDGET} AS BIGINT) AS run_id, key, seq, kind, value, bytes FROM sized)"""
LEVELS = RUNS + """, leveled AS (
    SELECT *, CAST(((SELECT max(run_id) FROM entries) - run_id) * 4 // ((SELECT max(run_id) FROM entries) + 1) AS BIGINT) AS level FROM entries)"""
META = LEVELS + """, meta AS (
    SELECT level, run_id, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq,
           count(*) AS n_entries, CAST(sum(bytes) AS BIGINT) AS data_bytes FROM leveled GROUP BY ALL)"""
NEWEST = """newest AS (
    SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {src}) WHERE rn = 1)"""


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


# the log


@query(f"WITH {LOG} SELECT * FROM log")
def log_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir)


@query(f"WITH {LOG} SELECT batch_id, count(*) AS n_ops, CAST(2 + coalesce(sum(count(*)) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base_seq FROM log GROUP BY batch_id")
def batch_seq_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.batch_bases(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT batch_id, count(*) AS n_ops FROM log GROUP BY batch_id")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.batch_sizes(event_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT batch_id, ord, seq, kind, key, value FROM log")
def batch_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.explode_batches(logs.as_batches(event_log(spark, sf_dir)))


@query(f"WITH {LOG} SELECT batch_id, ord, kind, key, value, seq FROM log")
def assign_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.assign_sequences(event_log(spark, sf_dir).drop("seq"))


@query(f"WITH {LOG} SELECT key, seq, kind, count(*) AS n FROM (SELECT * FROM log UNION ALL SELECT * FROM log) GROUP BY ALL HAVING count(*) > 1")
def strict_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return logs.strict_duplicates(log.unionByName(log))


@query(f"WITH {LOG} SELECT batch_id, ord, seq, kind, key, value FROM log")
def wal_replay_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return logs.replayed(log, log)


# internal keys


@query(f"WITH {LOG} SELECT seq, seq * 256 + kind AS meta FROM log")
def meta_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", keys.pack_meta(F.col("seq"), F.col("kind")).alias("meta"))


@query(f"WITH {LOG} SELECT seq * 256 + kind AS meta, seq, kind FROM log")
def meta_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = event_log(spark, sf_dir).select(keys.pack_meta(F.col("seq"), F.col("kind")).alias("meta"))
    return meta.select("meta", keys.meta_seq(F.col("meta")).alias("seq"), keys.meta_kind(F.col("meta")).cast("long").alias("kind"))


@query(f"WITH {LOG} SELECT seq, hex(encode(key)) || lpad(to_hex(seq * 256 + kind), 16, '0') AS ikey FROM log")
def ikey_serialize_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", F.hex(keys.serialize(F.col("key"), F.col("seq"), F.col("kind"))).alias("ikey"))


@query(f"WITH {LOG} SELECT key, seq, kind FROM log")
def ikey_deserialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = event_log(spark, sf_dir).select(keys.deserialize(keys.serialize(F.col("key"), F.col("seq"), F.col("kind"))).alias("k"))
    return raw.select(F.col("k.key").cast("string").alias("key"), "k.seq", F.col("k.kind").cast("long").alias("kind"))


@query(f"WITH {LOG} SELECT seq, 'UserKey: ' || key || ' SeqNum: ' || seq || ' Kind: ' || kind AS described FROM log")
def ikey_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).select("seq", keys.describe(F.col("key"), F.col("seq"), F.col("kind")).alias("described"))


@query(f"WITH {LOG} SELECT key, seq, kind, row_number() OVER (ORDER BY key, seq DESC, kind DESC) AS rank FROM log")
def ikey_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.ranked(event_log(spark, sf_dir).select("key", "seq", "kind"), keys.internal_order())


@query(f"WITH {SIZED} SELECT seq, bytes, bytes + 20 AS reserved FROM sized")
def entry_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, value = F.col("key"), F.col("value")
    return event_log(spark, sf_dir).select("seq", keys.entry_bytes(key, value).alias("bytes"), keys.reserved_bytes(key, value).alias("reserved"))


@query(f"WITH {SIZED} SELECT seq, CAST(sum(bytes) OVER (ORDER BY seq) AS BIGINT) AS memtable_bytes FROM sized")
def memtable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = event_log(spark, sf_dir).select("seq", keys.entry_bytes(F.col("key"), F.col("value")).alias("bytes"))
    return logs.running_total(sized, "seq", "bytes", "memtable_bytes").select("seq", "memtable_bytes")


# lookups


def _one(where: str) -> str:
    return f"WITH {LOG} SELECT key, seq, kind, value FROM log WHERE {where} ORDER BY seq DESC LIMIT 1"


@query(f"SELECT key, seq, value FROM ({_one(f"key = '{LOOKUPS['live']}'")}) WHERE kind = 0")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.get(event_log(spark, sf_dir), LOOKUPS["live"]).select("key", "seq", "value")


@query(f"""WITH {LOG}, {NEWEST.format(src='log')}, gone AS (SELECT min(key) AS key FROM newest WHERE kind = 1)
    SELECT newest.key, newest.seq, newest.kind, true AS found FROM newest JOIN gone USING (key)""")
def raw_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deleted key is found, as a tombstone."""
    log = event_log(spark, sf_dir)
    gone = state.tombstones(log).agg(F.min("key")).first()[0]
    return state.raw_get(log, F.lit(gone)).select("key", "seq", "kind", F.lit(True).alias("found"))


@query(f"SELECT key, seq, value FROM ({_one(f"key = '{LOOKUPS['missing']}'")}) WHERE kind = 0")
def point_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.get(event_log(spark, sf_dir), LOOKUPS["missing"]).select("key", "seq", "value")


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq, kind, value FROM newest")
def raw_get_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(event_log(spark, sf_dir)).select("key", "seq", "kind", "value")


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq, value FROM newest WHERE kind = 0")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current_state(event_log(spark, sf_dir)).select("key", "seq", "value")


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq FROM newest WHERE kind = 1")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstones(event_log(spark, sf_dir)).select("key", "seq")


@query(f"""WITH {LOG}, {NEWEST.format(src='log')}, live AS (SELECT key, seq, value FROM newest WHERE kind = 0)
    SELECT k.key, live.seq IS NOT NULL AS found, live.seq, live.value FROM (SELECT 'user.' || c_custkey AS key FROM customer) k LEFT JOIN live USING (key)""")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("user."), F.col("c_custkey").cast("string")).alias("key"))
    return state.multi_get(event_log(spark, sf_dir), wanted)


@query(f"WITH {LOG} SELECT key, seq, kind, value, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS next_seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) - 1 AS age FROM log")
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.history(event_log(spark, sf_dir)).select("key", "seq", "kind", "value", "next_seq", F.col("age"))


@query(f"WITH {LOG}, past AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)), {NEWEST.format(src='past')} SELECT key, seq, value FROM newest WHERE kind = 0")
def as_of_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after half of the log."""
    log = event_log(spark, sf_dir)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    return state.as_of(log, half).select("key", "seq", "value")


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq, value FROM newest WHERE kind = 0 AND key LIKE 'user.1%'")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.prefix_scan(event_log(spark, sf_dir), "user.1").select("key", "seq", "value")


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq, value FROM newest WHERE kind = 0 AND key >= 'user.2' AND key < 'user.5'")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.range_scan(event_log(spark, sf_dir), "user.2", "user.5").select("key", "seq", "value")


# runs


@query(f"WITH {RUNS} SELECT run_id, key, seq, kind, value FROM entries")
def run_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_runs(spark, sf_dir)


@query(f"""WITH RECURSIVE {SIZED}, b AS (SELECT batch_id, sum(bytes) AS bytes, row_number() OVER (ORDER BY batch_id) AS i FROM sized GROUP BY batch_id),
    f AS (SELECT i, batch_id, 0 AS run_id, bytes AS used FROM b WHERE i = 1
          UNION ALL SELECT b.i, b.batch_id, CASE WHEN f.used > {RUN_BUDGET} THEN f.run_id + 1 ELSE f.run_id END,
                 CASE WHEN f.used > {RUN_BUDGET} THEN b.bytes ELSE f.used + b.bytes END FROM f JOIN b ON b.i = f.i + 1)
    SELECT CAST(run_id AS BIGINT) AS run_id, min(batch_id) AS first_batch, max(batch_id) AS last_batch, count(*) AS n_batches FROM f GROUP BY run_id""")
def run_rotation_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = runs.rotate_exactly(event_log(spark, sf_dir), RUN_BUDGET)
    return cut.groupBy("run_id").agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"), F.countDistinct("batch_id").alias("n_batches"))


@query(f"WITH {META} SELECT * FROM meta")
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata(spark, sf_dir)


@query(f"WITH {RUNS} SELECT run_id, key, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) AS rn FROM entries) WHERE rn = 1")
def run_newest_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.newest_per_run(event_runs(spark, sf_dir))


@query(f"WITH {LEVELS} SELECT key, level, run_id, seq, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC, seq DESC) AS rn FROM leveled) WHERE rn = 1")
def level_precedence_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.by_precedence(event_levels(spark, sf_dir)).select("key", "level", "run_id", "seq", "kind", "value")


@query(f"WITH {RUNS} SELECT run_id, key, seq, kind, value FROM entries WHERE run_id = (SELECT max(run_id) FROM entries) ORDER BY key, seq DESC")
def memtable_iterator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.memtable(event_runs(spark, sf_dir))


@query(f"WITH {META} SELECT run_id, min_key, max_key, n_entries FROM meta ORDER BY min_key, run_id")
def concat_runs_by_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.in_key_order(run_metadata(spark, sf_dir)).select("run_id", "min_key", "max_key", "n_entries")


@query(f"WITH {META} SELECT u.run_id, u.min_key, u.max_key FROM meta u WHERE u.level > 0 AND u.min_key <= (SELECT max(max_key) FROM meta WHERE level = 0) AND u.max_key >= (SELECT min(min_key) FROM meta WHERE level = 0)")
def overlap_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = run_metadata(spark, sf_dir)
    return runs.overlapping(meta.where("level = 0"), meta.where("level > 0")).select("run_id", "min_key", "max_key")


@query(f"WITH {META} SELECT level, run_id FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY run_id) AS rn FROM meta) WHERE rn = 1")
def oldest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata(spark, sf_dir).groupBy("level").agg(F.min("run_id").alias("run_id"))


INDEX = RUNS + f""", idx AS (
    SELECT run_id, CAST(pos // {PER_BLOCK} AS BIGINT) AS block, min(key) AS min_key, count(*) AS n_entries
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY key, seq DESC) - 1 AS pos FROM entries) GROUP BY ALL)"""


@query(f"WITH {INDEX} SELECT * FROM idx")
def sparse_index_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sparse_index(event_runs(spark, sf_dir), PER_BLOCK)


@query(f"WITH {INDEX}, k AS (SELECT DISTINCT 'user.' || c_custkey AS key FROM customer) SELECT k.key, idx.run_id, max(idx.min_key) AS min_key FROM k JOIN idx ON idx.min_key <= k.key GROUP BY ALL")
def index_floor_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("user."), F.col("c_custkey").cast("string")).alias("key"))
    return runs.floor_seek(runs.sparse_index(event_runs(spark, sf_dir), PER_BLOCK), wanted)


_BITS = ", ".join(f"CAST(('0x' || substring(md5(key), {1 + 7 * i}, 7)) AS BIGINT) % {BLOOM_BITS}" for i in range(3))


@query(f"""WITH {LOG}, bits AS (SELECT DISTINCT unnest([{_BITS}]) AS bit FROM log),
    asked AS (SELECT DISTINCT key, unnest([{_BITS}]) AS bit FROM (SELECT DISTINCT 'user.' || c_custkey AS key FROM customer))
    SELECT key FROM asked LEFT JOIN (SELECT bit AS hit FROM bits) ON bit = hit GROUP BY key HAVING count(*) = count(hit)""")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = runs.bloom_build(event_log(spark, sf_dir).select("key").distinct(), BLOOM_BITS)
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("user."), F.col("c_custkey").cast("string")).alias("key"))
    return runs.bloom_probe(wanted, built, BLOOM_BITS)


# levels and compaction


@query(f"WITH {META} SELECT level, CAST(sum(data_bytes) AS BIGINT) AS level_bytes, count(*) AS n_runs FROM meta GROUP BY level")
def level_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.level_bytes(run_metadata(spark, sf_dir))


SCORES = META + f""", scored AS (
    SELECT level, CAST(sum(data_bytes) AS BIGINT) AS level_bytes, CAST(sum(data_bytes) * 1000000 // (level * {LEVEL_BASE}) AS BIGINT) AS score_ppm FROM meta WHERE level > 0 GROUP BY level)"""


@query(f"WITH {SCORES} SELECT * FROM scored")
def level_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.level_scores(run_metadata(spark, sf_dir), compaction.Options(base_bytes=LEVEL_BASE))


@query(f"WITH {SCORES} SELECT level, score_ppm FROM scored ORDER BY score_ppm DESC, level LIMIT 1")
def pick_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = compaction.level_scores(run_metadata(spark, sf_dir), compaction.Options(base_bytes=LEVEL_BASE))
    return scores.orderBy(F.desc("score_ppm"), "level").limit(1).select("level", "score_ppm")


@query(f"WITH {META} SELECT count(*) AS n_runs, count(*) >= 2 AS triggered FROM meta WHERE level = 0")
def l0_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_metadata(spark, sf_dir).where("level = 0").agg(F.count("*").alias("n_runs")).withColumn("triggered", F.col("n_runs") >= 2)


@query(f"WITH {LEVELS}, zero AS (SELECT * FROM leveled WHERE level = 0), {NEWEST.format(src='zero')} SELECT key, seq, kind, value FROM newest")
def kway_merge_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = event_levels(spark, sf_dir).where("level = 0").select("key", "seq", "kind", "value")
    return merge.merge_runs(zero)


@query(f"WITH {LEVELS}, two AS (SELECT * FROM leveled WHERE level <= 1), {NEWEST.format(src='two')} SELECT key, seq, kind, value FROM newest")
def two_level_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = event_levels(spark, sf_dir)
    side = lambda n: state.latest(entries.where(F.col("level") == n).select("key", "seq", "kind", "value"))
    return merge.merge_levels(side(0), side(1))


@query(f"""WITH {META}, span AS (SELECT min(min_key) AS low, max(max_key) AS high FROM meta WHERE level = 0),
    chosen AS (SELECT run_id FROM meta, span WHERE level = 0 OR (level = 1 AND min_key <= high AND max_key >= low)),
    src AS (SELECT * FROM leveled WHERE run_id IN (SELECT run_id FROM chosen)), {NEWEST.format(src='src')} SELECT key, seq, kind, value FROM newest""")
def compaction_l0_to_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of level 0 with what it overlaps of level 1; tombstones stay."""
    entries = event_levels(spark, sf_dir)
    meta = metadata(entries)
    chosen = runs.overlapping(meta.where("level = 0"), meta.where("level <= 1")).select("run_id")
    return merge.merge_runs(entries.join(chosen, "run_id", "left_semi").select("key", "seq", "kind", "value"))


@query(f"""WITH {SIZED}, {NEWEST.format(src='sized')} SELECT key, seq, kind, CAST((sum(bytes) OVER (ORDER BY key) - bytes) // {SPLIT_BYTES} AS BIGINT) AS run_id FROM newest""")
def compaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = state.latest(event_log(spark, sf_dir).select("key", "seq", "kind", "value"))
    return merge.split_runs(merged, SPLIT_BYTES).select("key", "seq", "kind", "run_id")


# recovery and housekeeping


@query(f"WITH {META} SELECT run_id, lpad(CAST(run_id AS VARCHAR), 9, '0') || '.log' AS name FROM meta WHERE run_id >= 2")
def recover_wal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = run_metadata(spark, sf_dir).select(keys.log_name(F.col("run_id")).alias("name"))
    return named.withColumn("run_id", keys.log_number(F.col("name"))).where("run_id >= 2")


@query("SELECT n_nationkey AS number, lpad(CAST(n_nationkey AS VARCHAR), 9, '0') || '.log' AS name FROM nation")
def wal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), keys.log_name(F.col("n_nationkey")).alias("name"))


@query(f"WITH {META} SELECT run_id FROM meta WHERE level = 0")
def dead_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = run_metadata(spark, sf_dir)
    return unreferenced(meta.select("run_id"), meta.where("level > 0"), "run_id")


@query(f"""SELECT 'user.' || user_id AS key, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us FROM events GROUP BY user_id
    HAVING max(ts) + INTERVAL {CACHE_SECONDS} SECOND > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def cache_ttl_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose last use is less than the lifetime before a moment, an hour before the log's end."""
    used = table(spark, sf_dir, "events").select(F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("key"), "ts")
    last = used.groupBy("key").agg(F.max("ts").alias("last"))
    end = last.agg(F.max("last").alias("end"))
    alive = F.col("last") + F.expr(f"INTERVAL {CACHE_SECONDS} SECOND") > F.col("end") - F.expr("INTERVAL 1 HOUR")
    return last.join(F.broadcast(end), alive).select("key", F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))  # of one row


# the log as a stream


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return _as_log(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(os.path.join(sf_dir, "events*")))


@query(f"WITH {LOG}, {NEWEST.format(src='log')} SELECT key, seq, kind, value FROM newest")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches become runs; the state over all runs is that of the log."""
    folder = new_path(spark, "stream-runs")
    ingest.write_runs(_event_stream(spark, sf_dir), folder, new_path(spark, "stream-checkpoint")).awaitTermination()
    schema = T.StructType.fromDDL("batch_id long, ord long, seq long, kind long, key string, value string, run_id long")
    return ingest.state_of_runs(spark.read.schema(schema).parquet(folder)).select("key", "seq", "kind", "value")


# the same at larger scale


@query("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS seq, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS kind, o_orderpriority AS value FROM orders)
    SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM o) WHERE rn = 1 AND kind = 0""")
def orders_upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("key"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("kind"),
        F.col("o_orderpriority").alias("value"),
    )
    return state.current_state(o).select("key", "seq", "value")


@query("""SELECT l_partkey AS key, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_suppkey, l_returnflag AS value FROM (
    SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def lineitem_latest_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), F.col("l_returnflag").alias("value"))
    return state.latest(rows).select("key", "seq.l_orderkey", F.col("seq.l_linenumber").cast("long").alias("l_linenumber"), "seq.l_suppkey", "value")


def _all() -> None:
    from keyloom import storage_queries  # noqa: F401  registers its own


def queries() -> dict[str, Query]:
    _all()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_sql)
