import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys
from keyloom.operators import log as logs
from keyloom.operators import merge, runs, state
from keyloom.plans.catalog import Manifest
from keyloom.plans.compaction import Options, Plan, Run, next_plan

SCHEMA = "batch_id long, ord long, seq long, kind int, key string, value string"


def make_log(spark, ops):
    return spark.createDataFrame([(i // 3, i % 3, i + 2, kind, key, value) for i, (kind, key, value) in enumerate(ops)], SCHEMA)


def random_ops(seed, n=120):
    rng = random.Random(seed)
    return [(0, f"k{rng.randrange(25)}", str(rng.randrange(1000))) if rng.random() < 0.75 else (1, f"k{rng.randrange(25)}", None) for _ in range(n)]


def truth(ops):
    live = {}
    for kind, key, value in ops:
        live.pop(key, None) if kind else live.update({key: value})
    return live


def as_dict(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_state_is_independent_of_runs_and_compaction(spark, seed):
    ops = random_ops(seed)
    log = make_log(spark, ops)
    want = truth(ops)
    assert as_dict(state.current_state(log)) == want
    cut = log.withColumn("run_id", F.pmod(F.hash("seq"), F.lit(5)).cast("long"))
    per_run = runs.newest_per_run(cut.select("run_id", "key", "seq", "kind", "value"))
    assert as_dict(state.current_state(per_run.drop("run_id"))) == want
    parts = [cut.where(F.col("run_id") == i).select("key", "seq", "kind", "value") for i in range(5)]
    merged = merge.merge_runs(*parts)
    assert as_dict(merged.where("kind = 0")) == want
    assert merged.count() == log.select("key").distinct().count()
    older, newer = (state.latest(log.where(c).select("key", "seq", "kind", "value")) for c in ("seq < 60", "seq >= 60"))
    assert as_dict(merge.merge_levels(newer, older).where("kind = 0")) == want


def test_precedence_equals_newest(spark):
    log = make_log(spark, random_ops(3))
    leveled = log.withColumns({"run_id": F.floor(F.col("seq") / 20), "level": F.greatest(F.lit(0), 3 - F.floor(F.col("seq") / 40))})
    a = merge.by_precedence(leveled.select("key", "level", "run_id", "seq", "kind", "value"))
    assert {(r.key, r.seq) for r in a.collect()} == {(r.key, r.seq) for r in state.latest(log).collect()}


def test_replay_twice_changes_nothing(spark):
    log = make_log(spark, random_ops(4))
    assert logs.replayed(log, log.where("seq > 50")).count() == log.count()
    assert logs.strict_duplicates(log).count() == 0


def test_order_and_golden_bytes(spark):
    df = spark.createDataFrame([("a", 1000, 0), ("b", 200, 0), ("a", 1001, 0)], "key string, seq long, kind int")
    assert [(r.key, r.seq) for r in df.orderBy(*keys.internal_order()).collect()] == [("a", 1001), ("a", 1000), ("b", 200)]
    one = spark.createDataFrame([("testKey", 10000, 0)], "key string, seq long, kind int")
    raw = keys.serialize(F.col("key"), F.col("seq"), F.col("kind"))
    r = one.select(F.hex(raw).alias("h"), keys.deserialize(raw).alias("d")).first()
    assert r.h == "746573744B65790000000000271000" and bytes(r.d.key) == b"testKey" and r.d.seq == 10000
    high = spark.createDataFrame([(bytearray(b),) for b in (b"\x80", b"a", b"\x7f", b"ab")], "key binary")
    assert [bytes(r.key) for r in high.orderBy("key").collect()] == [b"a", b"ab", b"\x7f", b"\x80"]


def test_memtable_size_and_log_names(spark):
    df = spark.createDataFrame([("foo", "bar"), ("foo1", "bar1"), ("foo2", "bar2"), ("foo3", "bar3")], "key string, value string")
    assert df.agg(F.sum(keys.entry_bytes(F.col("key"), F.col("value")))).first()[0] == 62
    names = spark.createDataFrame([("x/000000012.log",), ("x/a.log",), ("000000003.log",)], "n string")
    assert [r[0] for r in names.select(keys.log_number(F.col("n"))).collect()] == [12, None, 3]


def test_rotation_golden(spark):
    ops = spark.range(100_000).select(F.col("id").alias("batch_id"), (F.col("id") + 2).alias("seq"), F.concat(F.lit("foo."), F.col("id").cast("string")).alias("key"), F.concat(F.lit("bar."), F.col("id").cast("string")).alias("value"))
    cut = runs.rotate_exactly(ops, 1 << 20, width=1000).groupBy("run_id").agg(F.count("*").alias("n"), F.sum(keys.entry_bytes(F.col("key"), F.col("value"))).alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    cut = cut.orderBy("run_id").collect()
    assert [(r.n, r.bytes) for r in cut[:2]] == [(41_185, 1_048_590), (40_330, 1_048_580)] and cut[2].n == 18_485
    assert (cut[0].low, cut[0].high) == ("foo.0", "foo.9999") and (cut[1].low, cut[1].high) == ("foo.41185", "foo.81514")


def test_running_total_and_rank_cross_buckets(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 7).alias("v"))
    got = {r.seq: r.t for r in logs.running_total(df, "seq", "v", "t", width=64).collect()}
    s = 0
    for i in range(1000):
        s += i % 7
        assert got[i] == s
    ranks = runs.ranked(df, [F.desc("v"), F.asc("seq")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranks] == list(range(1, 1001))
    assert [(r.v, r.seq) for r in ranks] == sorted(((r.v, r.seq) for r in ranks), key=lambda x: (-x[0], x[1]))


def test_block_packing(spark):
    entries = spark.createDataFrame([(0, f"k{i:03d}", i, 0, "v" * (i % 50)) for i in range(300)], "run_id long, key string, seq long, kind int, value string")
    got = {(r.key): r.block for r in runs.pack_blocks(entries, 512).collect()}
    used = block = 0
    for i in range(300):
        own = 4 + 8 + i % 50
        if used + own + 20 > 512:
            used, block = 0, block + 1
        used += own
        assert got[f"k{i:03d}"] == block


def test_floor_seek_and_bloom(spark):
    index = spark.createDataFrame([(0, "b"), (0, "m"), (1, "a")], "run_id long, min_key string")
    keys_df = spark.createDataFrame([("a",), ("c",), ("z",), ("z",)], "key string")
    got = {(r.key, r.run_id): r.min_key for r in runs.floor_seek(index, keys_df).collect()}
    assert got == {("a", 1): "a", ("c", 0): "b", ("c", 1): "a", ("z", 0): "m", ("z", 1): "a"}
    members = spark.createDataFrame([("foo",), ("bar",), ("123",)], "key string")
    built = runs.bloom_build(members, 256)
    asked = members.unionByName(spark.createDataFrame([("fizz",), ("324",)], "key string"))
    found = {r.key for r in runs.bloom_probe(asked, built, 256).collect()}
    assert {"foo", "bar", "123"} <= found


def run(level, run_id, low="a", high="z", size=10):
    return Run(level, run_id, low.encode(), high.encode(), 1, size)


def test_policy():
    assert next_plan([]) is None
    assert next_plan([run(0, 1)]) is None
    plan = next_plan([run(0, 9, "c", "f"), run(0, 10, "d", "h"), run(1, 3, "a", "b"), run(1, 4, "h", "k")])
    assert plan == Plan(0, 1, [9, 10], [4])
    options = Options(base_bytes=100)
    assert next_plan([run(1, 5, size=60), run(1, 12, size=60), run(2, 2, size=10)], options) == Plan(1, 2, [5], [2])
    assert next_plan([run(4, 5, size=10_000)], options) is None
    assert Options(growth="multiplier").target(3) == Options().base_bytes * 100


def test_manifest_round_trip():
    m = Manifest("t", "/p", runs=[run(0, 7, "\x7f", "z")])
    assert Manifest.from_json(m.to_json()) == m


def test_history_of_hot_keys_is_the_same_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaabc"), seq, 0, str(seq)) for seq in rng.sample(range(10_000), 300)]
    versions = spark.createDataFrame(rows, "key string, seq long, kind int, value string")
    want = sorted(map(tuple, state.history(versions).collect()))
    for hot in (1, 7, 50):
        assert sorted(map(tuple, state.history(versions, hot).collect())) == want
    newest = {k: max(s for key, s, *_ in rows if key == k) for k, *_ in rows}
    assert {r[0]: r[1] for r in want if r[5] == 0} == newest and all(r[4] is None for r in want if r[5] == 0)


@pytest.mark.parametrize("ids", [[1, 5, 70_000, 1 << 33, (1 << 40) + 3, 1 << 62], list(range(20)), [0, (1 << 63) - 1]])
def test_running_total_of_sparse_orders(spark, ids):
    df = spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, n long")
    got = {r.id: r.total for r in logs.running_total(df, "id", "n", "total", levels=3).collect()}
    assert got == {i: sum(range(1, n + 2)) for n, i in enumerate(ids)}


def test_blocks_keep_binary_keys_and_split_where_the_rule_says(spark):
    rng = random.Random(8)
    rows = [(run, bytes(rng.randrange(250, 256) for _ in range(rng.randrange(1, 9))), seq, bytes(rng.randrange(60))) for run in (1, 2) for seq in range(80)]
    df = spark.createDataFrame([(r, bytearray(k), s, bytearray(v)) for r, k, s, v in rows], "run_id long, key binary, seq long, value binary")
    want = {}
    for run in (1, 2):
        used = number = 0
        for _, k, s, v in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], -r[2])):
            own = len(k) + 8 + len(v)
            if used and used + own + 20 > 256:
                used, number = 0, number + 1
            used += own
            want[run, k, s] = number
    packed = runs.pack_blocks(df, 256)
    assert {(r.run_id, bytes(r.key), r.seq): r.block for r in packed.collect()} == want
    assert runs.pack_blocks(df.limit(0)).count() == 0
    assert all(bytes(r.min_key) <= bytes(r.max_key) for r in runs.block_ranges(packed).collect())


@pytest.mark.parametrize("ranges", [1, 2, 9, 64])
def test_floor_seek_against_all_pairs(spark, ranges):
    rng = random.Random(ranges)
    index = [(run, f"{rng.randrange(50):02d}") for run in range(6) for _ in range(rng.randrange(1, 12))]
    asked = [f"{rng.randrange(60):02d}" for _ in range(40)]
    tops = {run: f"{rng.randrange(50, 60):02d}" for run in range(6)}
    marks = spark.createDataFrame(index, "run_id long, min_key string")
    wanted = spark.createDataFrame([(k,) for k in asked], "key string")
    meta = spark.createDataFrame(list(tops.items()), "run_id long, max_key string")
    floors = {(k, run): max((m for r, m in index if r == run and m <= k), default=None) for k in asked for run in range(6)}
    want = {(k, r): m for (k, r), m in floors.items() if m is not None}
    got = runs.floor_seek(marks, wanted, ranges=ranges).collect()
    assert len(got) == len(want) and {(r.key, r.run_id): r.min_key for r in got} == want
    pruned = {(r.key, r.run_id): r.min_key for r in runs.floor_seek(marks, wanted, meta, ranges).collect()}
    assert pruned == {(k, r): m for (k, r), m in want.items() if k <= tops[r]}
    assert runs.floor_seek(marks.limit(0), wanted).count() == 0


def test_bloom_filter_of_another_hash_survives_storage(spark):
    held = spark.createDataFrame([("foo",), ("bar",), ("123",)], "key string")
    words = runs.bloom_words(runs.bloom_build(held, 256, positions=runs.xx_positions))
    asked = spark.createDataFrame([(k,) for k in ("foo", "bar", "123", "fizz", "324")], "key string")
    found = {r.key for r in runs.bloom_probe(asked, runs.bloom_bits(words), 256, positions=runs.xx_positions).collect()}
    assert {"foo", "bar", "123"} <= found


def test_a_stored_lookup_reaches_the_scan(spark, tmp_path):
    from keyloom.sources import files

    path = f"file://{tmp_path}/t"
    entries = spark.range(500).select(F.concat(F.lit("k"), F.col("id").cast("string")).cast("binary").alias("key"), F.col("id").alias("seq"), F.lit(0).cast("tinyint").alias("kind"), F.lit(b"v").alias("value"))
    files.write_run(entries, path, 3, 500)
    found = state.raw_get(files.read_runs(spark, path, [3]).drop("run_id"), F.lit(b"k77"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key" in plan and found.first().seq == 77
    assert [r.seq for r in state.prefix_scan(files.read_runs(spark, path, [3]).drop("run_id"), b"k49").orderBy("seq").collect()] == [49, *range(490, 500)]


def test_cache_entries_expire():
    from keyloom.cache import Cache

    now = [0.0]
    c = Cache(seconds=3, most=2, clock=lambda: now[0])
    c.set("foo", "bar")
    c.set("baz", 1)
    assert c.get("foo") == "bar" and c.has("baz") and not c.has("none")
    now[0] = 2.0
    c.set("baz", 2)
    now[0] = 3.0
    assert not c.has("foo") and c.get("baz") == 2
    c.set("x", 3)
    c.set("y", 4)
    assert not c.has("baz") and c.get("x") == 3
    with pytest.raises(KeyError):
        c.get("foo")


@pytest.mark.parametrize("pruned", [False, True])
def test_floor_seek_shuffles_no_pairs(spark, pruned):
    """A row for each key and run may come out; none of them is shuffled, sorted or spilled."""
    marks = spark.range(400).select((F.col("id") % 40).alias("run_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("min_key"))
    meta = marks.groupBy("run_id").agg(F.lit("9999").alias("max_key"))
    wanted = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("key"))
    found = runs.floor_seek(marks, wanted, meta if pruned else None, 4)
    assert found.count() == sum(1000 - run for run in range(40))
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("AdaptiveSparkPlan") : plan.index("SortMergeJoin")]
    assert not any(node in above for node in ("Exchange", "Window", "Sort", "Aggregate")), above


def test_floor_seek_takes_repeated_and_null_keys_and_runs_of_one_key(spark):
    marks = spark.createDataFrame([(1, "m"), (1, "m"), (1, "m"), (2, "a"), (2, "z")], "run_id long, min_key string")
    wanted = spark.createDataFrame([("m",), (None,), ("l",), ("m",), ("zz",)], "key string")
    meta = spark.createDataFrame([(1, "m"), (2, "z")], "run_id long, max_key string")
    got = sorted(map(tuple, runs.floor_seek(marks, wanted).collect()))
    assert got == [("l", 2, "a"), ("m", 1, "m"), ("m", 2, "a"), ("zz", 1, "m"), ("zz", 2, "z")]
    assert sorted(map(tuple, runs.floor_seek(marks, wanted, meta).collect())) == [("l", 2, "a"), ("m", 1, "m"), ("m", 2, "a")]
    assert runs.floor_seek(marks, wanted.limit(0)).count() == 0


def test_a_block_scan_holds_few_blocks(spark):
    import pyarrow as pa

    from keyloom.storage_queries import SCAN_BYTES, scan_blocks

    held = [[{"key": b"k%03d" % i, "newest": -i, "seq": i, "kind": i % 2, "value": b"v" * 20} for i in range(120)] for _ in range(500)]
    held[7] = [{"key": b"long", "newest": -1, "seq": 1, "kind": 0, "value": b"x" * 1_000_000}]
    got = list(scan_blocks(iter([pa.RecordBatch.from_pydict({"run_id": list(range(500)), "held": held})])))
    assert len(got) > 2 and all(b.num_rows <= SCAN_BYTES // 4096 * 120 for b in got)
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    assert rows == [(run, e["key"], e["seq"], e["kind"], e["value"]) for run, block in enumerate(held) for e in block]
    assert list(scan_blocks(iter([]))) == []


def test_level_lookup_shuffles_no_pairs(spark):
    from keyloom import queries as engine

    found = engine.queries()["sst_level_lookup"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan[: plan.index("SortMergeJoin")] for node in ("Exchange", "Window", "Aggregate"))


@pytest.mark.parametrize("budget", [10, 120, 5000])
def test_gathered_runs_are_whole_and_in_order(spark, budget):
    """Buckets of running totals hold eight versions here; runs of one, of about six and of two hundred lie in them or across."""
    log = spark.range(2000).select((F.col("id") * 8192 + 2).alias("seq"), F.concat(F.lit("k"), (F.col("id") * 7 % 30).cast("string")).alias("key"), (F.col("id") % 2).alias("kind"))
    log = log.withColumns({"key": F.when(F.col("seq") != 77 * 8192 + 2, F.col("key")), "value": F.when(F.col("kind") == 0, F.repeat(F.lit("x"), (F.col("seq") / 8192 % 37).cast("int")))}).repartition(5)
    got = runs.gathered_runs(log, budget).withColumn("part", F.spark_partition_id()).collect()
    want = runs.assign_runs(log, budget).select("run_id", *log.columns).collect()
    assert sorted(map(str, (r[:-1] for r in got))) == sorted(map(str, map(tuple, want)))
    held, last = {}, {}
    assert [r.seq for r in got if r.run_id is None] == [77 * 8192 + 2]
    for r in (r for r in got if r.run_id is not None):
        assert held.setdefault(r.run_id, r.part) == r.part
        place = (r.run_id, r.key, -r.seq)
        assert last.get(r.part, (-1,)) < place
        last[r.part] = place


def test_small_runs_share_files(spark):
    from keyloom.storage_queries import _runs

    entries = _runs(spark, "/root/testdata/sf0.01")
    found = entries.select("run_id", "key", "seq", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at")).orderBy("file", "at").collect()
    n = len({r.run_id for r in found})
    assert len(found) == 10000 and n >= 14
    assert len({r.file for r in found}) == len(entries.inputFiles()) <= 8 < n  # tasks, not runs
    assert len({(r.run_id, r.file) for r in found}) == n
    by = [(r.file, r.run_id, r.key, -r.seq) for r in found]
    assert by == sorted(by)


def test_floor_seek_answers_each_chunk_run_by_run(spark, monkeypatch):
    """The keys of a chunk come in the same order for each run, which is what lets a stored answer compress; what goes by is one interval, not a chunk with all runs."""
    monkeypatch.setattr(runs, "SEEK_CHUNK", 256)
    marks = spark.range(400).select((F.col("id") * 7 % 40).alias("run_id"), F.lpad(F.col("id").cast("string"), 4, "0").alias("min_key"))
    wanted = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("key"))
    found = runs.floor_seek(marks, wanted, ranges=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    streamed = plan[plan.index("SortMergeJoin") :]
    assert streamed.index("_at#") < streamed.index("_keys#")
    found, chunks, turns = found.collect(), 4, 1
    for x, y in zip(found, found[1:]):
        turns += (y.run_id, y.key) < (x.run_id, x.key)
    assert len(found) == sum(1000 - run for run in range(40)) and turns == chunks
