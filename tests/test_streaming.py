"""Streams with availableNow, a restart in the middle, late rows."""

from pyspark.sql import functions as F

from shelfwright.streaming import incremental


def test_unseen_ids_across_restarts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = lambda: incremental.file_stream(spark, src, "site string, sid string")
    spark.createDataFrame([("s", "1"), ("s", "1"), ("s", "2")], "site string, sid string").coalesce(1).write.mode("append").parquet(src)
    for more in ([], [("s", "2"), ("s", "3")]):
        if more:
            spark.createDataFrame(more, "site string, sid string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.run_available(incremental.unseen(stream(), ["site", "sid"]), lambda b, n: b.write.mode("append").parquet(out), str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert sorted(r.sid for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_upsert_stream_refuses_late_rows(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([("a", 5, "new"), ("b", 1, "x")], [("a", 3, "late"), ("b", 2, "y")]):
        spark.createDataFrame(rows, "id string, seq int, v string").coalesce(1).write.mode("append").parquet(src)
        q = incremental.upsert_stream(incremental.file_stream(spark, src, "id string, seq int, v string"), ["id"], "seq", table, str(tmp_path / "ck"))
        q.awaitTermination(60)
    assert {r.id: r.v for r in incremental.read_version(spark, table).collect()} == {"a": "new", "b": "y"}


def test_sessions_and_dead_letters(spark):
    df = spark.createDataFrame([("k", 0), ("k", 100), ("k", 2000)], "key string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.seconds) for r in incremental.stalls(df, "key", "ts", 600).collect()] == [1900]
    got = incremental.attempt_numbers(incremental.attempts(df, "key", "ts", "600 seconds"), "key", 1).orderBy("attempt").collect()
    assert [(r.attempt, r.beats, r.given_up) for r in got] == [(1, 2, False), (2, 1, True)]
    good, dead = incremental.split_failures(df, F.col("s") < 150)
    assert (good.count(), dead.count()) == (2, 1)
