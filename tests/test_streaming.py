from keyloom.streaming import ingest


def test_newest_versions_over_late_rows(spark, tmp_path):
    schema = "key string, seq long, kind int, value string"
    parts = [[("a", 5, 0, "new"), ("b", 1, 0, "x")], [("a", 3, 0, "late"), ("b", 2, 1, None)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = ingest.newest_versions(stream).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.sql("select * from newest").collect()
    last = {}
    for r in rows:
        if r.key not in last or r.seq > last[r.key].seq:
            last[r.key] = r
    assert (last["a"].value, last["a"].seq) == ("new", 5) and last["b"].kind == 1


def test_repeated_micro_batch_overwrites_its_run(spark, tmp_path):
    schema = "key string, seq long, kind int, value string"
    spark.createDataFrame([("a", 1, 0, "x"), ("a", 2, 0, "y")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    for c in ("c1", "c2"):  # the second one starts over, as after a lost checkpoint
        ingest.write_runs(stream, f"{tmp_path}/out", f"{tmp_path}/{c}").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2
    assert [r.value for r in ingest.state_of_runs(out).collect()] == ["y"]
