from pyspark.sql import functions as F

from corpusloom.streaming import events as E

FOLDER = "/root/testdata/sf0.001/events.parquet"


def drain(df, mode, name, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def parts(spark, tmp_path):
    """The events as several files in order of time, as a watcher would see them."""
    e = spark.read.parquet(FOLDER)
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).orderBy("ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_windows_equal_their_batch_twin(spark, tmp_path):
    stream = E.event_stream(spark, parts(spark, tmp_path), 10)
    got = drain(E.windowed(stream), "complete", "w", spark)
    want = E.windowed(spark.read.parquet(FOLDER))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_filter_and_debounce(spark, tmp_path):
    folder = parts(spark, tmp_path)
    got = drain(E.wanted(E.event_stream(spark, folder, 10)).select("event_id"), "append", "f", spark)
    assert got.count() == E.wanted(spark.read.parquet(FOLDER)).count()
    sessions = drain(E.debounced(E.event_stream(spark, folder, 10), watermark="1 hour"), "complete", "d", spark)
    assert sessions.agg(F.sum("n")).first()[0] == spark.read.parquet(FOLDER).count()
    want = E.debounced(spark.read.parquet(FOLDER))
    assert sorted(map(tuple, sessions.collect())) == sorted(map(tuple, want.collect()))


def test_stateful_retries_equal_their_batch_twin(spark, tmp_path):
    e = spark.read.parquet(FOLDER)
    e.coalesce(1).write.parquet(str(tmp_path / "one"))
    got = drain(E.stateful_retries(E.event_stream(spark, str(tmp_path / "one"))), "update", "r", spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, E.retry_counts(e).collect()))


def test_upsert_batches(spark, tmp_path):
    folder = parts(spark, tmp_path)
    E.upsert_batches(E.event_stream(spark, folder, 10), str(tmp_path / "out"), "user_id", str(tmp_path / "cp")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("batch", "user_id").count().where("count > 1").count() == 0 and out.count() > 0
    E.upsert_batches(E.event_stream(spark, folder, 1), str(tmp_path / "good"), "user_id", str(tmp_path / "cp2"), valid=F.col("event_type") != "error").awaitTermination(120)
    latest = E.latest_of_batches(spark, str(tmp_path / "good"), "user_id")
    e = spark.read.parquet(folder)
    assert latest.count() == e.where("event_type <> 'error'").select("user_id").distinct().count()
    assert spark.read.parquet(str(tmp_path / "good-refused")).count() == e.where("event_type = 'error'").count()


def test_folds(spark):
    a = spark.createDataFrame([(1, 1, "do"), (1, 2, "do"), (1, 3, "undo"), (1, 4, "do"), (1, 5, "undo"), (1, 6, "redo"), (2, 1, "undo")], "session long, seq long, kind string")
    assert sorted(map(tuple, E.undo_log(a).collect())) == [(1, 1, True), (1, 4, True)]
    rows = [(k, f"2024-01-01 00:00:{k:02d}", 1, "error" if k < 5 else "view") for k in range(8)] + [(9, "2024-01-01 00:01:00", 1, "view"), (10, "2024-01-01 00:01:01", 1, "view")]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert E.circuit_states(e).first().asDict() == {"user_id": 1, "state": "CLOSED", "opened": 1}
    assert [r["event_id"] for r in E.accepted_after_gap(e, 5).orderBy("event_id").collect()] == [0, 5, 9]


def watched(spark, rows, tmp_path):
    """Rows (event_id, seconds, user_id) as files, one a call of ``next`` of the watcher, in this order."""
    for k, part in enumerate(rows):
        df = spark.createDataFrame(part, "event_id long, t double, user_id long").select("event_id", F.timestamp_micros((F.col("t") * 1e6).cast("long")).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"{k}"))
    from pathlib import Path
    from shutil import copy
    from time import sleep

    (tmp_path / "all").mkdir()
    for k in range(len(rows)):
        for f in Path(tmp_path / f"{k}").glob("part-*"):
            copy(f, tmp_path / "all" / f"{k}-{f.name}")
        sleep(1.1)  # the source reads files by their time
    return str(tmp_path / "all")


def test_flushes_equal_their_batch_twin(spark, tmp_path):
    times = [0.0, 0.5, 1.2, 1.9, 2.5, 3.2, 3.9, 4.6, 5.3, 9.0, 9.2]
    busy = [(k, 100 + t, 1) for k, t in enumerate(times)]
    folder = watched(spark, [busy[:4], busy[4:], [(50, 4_000.0, 9)], [(51, 9_000.0, 9)], [(52, 15_000.0, 9)]], tmp_path)
    got = drain(E.flushed_stream(E.event_stream(spark, folder)), "append", "flushes", spark)
    want = E.flushed(spark.read.parquet(folder))
    mine = lambda df: sorted(map(tuple, df.where("user_id = 1").collect()))
    assert mine(got) == mine(want) and len(mine(want)) == 3


def test_deletes_without_an_add_time_out(spark, tmp_path):
    folder = watched(spark, [[(1, 100.0, 1), (2, 100.5, 1), (4, 100.0, 3)], [(10, 101.0, 1)], [(60, 4_000.0, 9), (62, 4_000.0, 8)], [(61, 9_000.0, 9), (63, 9_000.0, 8)], [(65, 15_000.0, 9), (66, 15_000.0, 8)]], tmp_path)
    sides = lambda df: (df.where("event_id IN (1, 4, 62, 63, 66)"), df.where("event_id NOT IN (1, 4, 62, 63, 66)"))
    shape = lambda df: df.select(F.col("event_id").alias("id"), F.col("user_id").alias("size"), F.lit(".x").alias("ext"), "ts")
    d, a = map(shape, sides(E.event_stream(spark, folder)))
    got = drain(E.move_candidates(d, a, watermark="3 seconds"), "append", "moves", spark)
    want = E.move_candidates(*map(shape, sides(spark.read.parquet(folder))))
    early = lambda df: sorted((r["deleted"], r["added"] or 0) for r in df.where("deleted < 10").collect())
    assert early(got) == early(want) == [(1, 2), (1, 10), (4, 0)]
