"""Retries over several runs and restarts, and silences told on a stream, against what the batch forms say."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfwright.streaming import incremental, keyed

ITEMS = "cat string, sid string, seq int, k int"


def test_failed_items_are_tried_again(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "ck")

    def run(rows, accept):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), ITEMS, 100)
        keyed.retry_stream(stream, ["cat", "sid"], F.col("k").isin(*accept), "seq", path, state, most=3).awaitTermination(60)
        settled = {(r.cat, r.sid): (r.status, r.attempt, r.seq) for r in keyed.settled(spark, path).collect()}
        waiting = {(r.cat, r.sid): r.attempt for r in keyed.waiting(spark, path, ["cat", "sid"]).collect()}
        assert len(settled) == keyed.settled(spark, path).count()
        return settled, waiting

    settled, waiting = run([("a", "1", 1, 0), ("a", "2", 1, 1), ("b", "1", 1, 2), ("b", "2", 1, None), ("a", "1", 2, 0)], [0])
    assert settled == {("a", "1"): ("good", 1, 2)} and waiting == {("a", "2"): 1, ("b", "1"): 1, ("b", "2"): 1}
    # a new run of the program, which now reads k = 1 too: a/2 becomes good; a/1 comes again and is not tried
    settled, waiting = run([("a", "1", 3, 7), ("c", "1", 1, 5)], [0, 1])
    assert settled == {("a", "1"): ("good", 1, 2), ("a", "2"): ("good", 2, 1)} and waiting == {("b", "1"): 2, ("b", "2"): 2, ("c", "1"): 1}
    items = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1")], "cat string, sid string")
    marked = {r.cat: (r["items"], r.done) for r in keyed.marked_categories(items, keyed.settled(spark, path), ["cat"], ["cat", "sid"]).collect()}
    assert marked == {"a": (2, True), "b": (2, False), "c": (1, False)}
    settled, waiting = run([], [0, 1, 2])
    assert settled[("b", "1")] == ("good", 3, 1) and settled[("b", "2")] == ("refused", 3, 1) and waiting == {("c", "1"): 2}
    settled, waiting = run([("b", "2", 9, 0)], [0])
    assert settled[("b", "2")] == ("refused", 3, 1) and settled[("c", "1")] == ("refused", 3, 1) and waiting == {}


def test_silences_equal_the_batch_form(spark, tmp_path):
    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows, t = [], {k: 0.0 for k in "abcde"}
    for _ in range(300):
        k = rng.choice("abcde")
        t[k] += rng.choice((5, 20, 59.5, 60, 60.000001, 61, 400, 3000))
        rows.append((k, start + timedelta(seconds=t[k])))
    rows.sort(key=lambda r: r[1])
    rows = [r for i in range(0, 300, 10) for r in rng.sample(rows[i : i + 10], len(rows[i : i + 10]))]  # out of order by a little
    rows.append(("z", start + timedelta(days=30)))  # moves the watermark past all others
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i not in (120, 300):  # two runs of several batches each
            continue
        stream = keyed.stall_stream(incremental.file_stream(spark, str(tmp_path / "in"), "key string, ts timestamp", 1), ["key"], "ts", 60, "1 day")
        keyed.start(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True), spark).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).where("key <> 'z'").collect()
    beats = spark.createDataFrame(rows[:-1], "key string, ts timestamp")
    want = {(r.key, r.since, r.until, r.seconds) for r in incremental.stalls(beats, "key", "ts", 60).collect()}
    assert want and {(r.key, r.since, r.until, r.seconds) for r in got if r.kind == "resumed"} == want
    last = {(r.key, r.m) for r in beats.groupBy("key").agg(F.max("ts").alias("m")).collect()}
    silent = [(r.key, r.since) for r in got if r.kind == "silent"]
    assert len(silent) == len(set(silent)) and set(silent) == {(k, s) for k, s, _, _ in want} | last


def test_silence_is_told_while_nothing_arrives(spark, tmp_path):
    """Another key's beats move the watermark; the silent key gets no row, and its silence is told before it beats again."""
    start, seen = datetime(2024, 1, 1), []
    for batch in ([("a", 0), ("b", 0)], [("b", 300)], [("a", 320), ("b", 400)], [("b", 600)]):
        spark.createDataFrame([(k, start + timedelta(seconds=s)) for k, s in batch], "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = keyed.stall_stream(incremental.file_stream(spark, str(tmp_path / "in"), "key string, ts timestamp", 1), ["key"], "ts", 100, "0 seconds")
        out = str(tmp_path / f"out{len(seen)}")
        keyed.start(stream.writeStream.foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True), spark).awaitTermination(60)
        seen.append({(r.key, r.kind) for r in spark.read.parquet(out).collect()} if (tmp_path / f"out{len(seen)}").exists() else set())
    first = next(i for i, s in enumerate(seen) if ("a", "silent") in s)
    back = next(i for i, s in enumerate(seen) if ("a", "resumed") in s)
    assert first < 2 <= back


def test_retries_keep_their_counts_in_tables(spark, tmp_path):
    """No state operator, thus no call of Python for each item (F7). A missing key is a key; what is settled is forgotten after `kept` days."""
    path = str(tmp_path / "t")

    def run(rows, kept):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), ITEMS, 100)
        found = keyed.retry_stream(stream, ["cat", "sid"], F.col("k") == 0, "seq", path, str(tmp_path / "ck"), most=2, kept=kept)
        found.awaitTermination(60)
        assert found.lastProgress["stateOperators"] == []
        return sorted((r.cat, r.sid or "", r.status, r.attempt) for r in keyed.settled(spark, path).collect())

    assert run([("a", None, 1, 0), ("a", None, 2, 5), ("b", "1", 1, 1)], 90) == [("a", "", "good", 1)]
    assert run([("a", None, 3, 0), ("c", "1", 1, 0)], 90) == [("a", "", "good", 1), ("b", "1", "refused", 2), ("c", "1", "good", 1)]
    assert run([("c", "1", 2, 0)], 0) == [("a", "", "good", 1), ("b", "1", "refused", 2), ("c", "1", "good", 1), ("c", "1", "good", 1)]


def test_silences_of_keys_in_few_buckets(spark, tmp_path):
    """Beats of many keys are worked off together (F9): long numbers and a missing key stay apart."""
    start, big = datetime(2024, 1, 1), 2**60
    rows = [(big + i % 7 if i % 7 else None, start + timedelta(seconds=37 * i + (i % 5) * 60)) for i in range(200)] + [(-1, start + timedelta(days=30))]
    spark.createDataFrame(rows, "key long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keyed.stall_stream(incremental.file_stream(spark, str(tmp_path / "in"), "key long, ts timestamp", 1), ["key"], "ts", 260, "1 hour", buckets=2)
    keyed.start(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True), spark).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).where("key is null or key > 0").collect()
    want = {tuple(r) for r in incremental.stalls(spark.createDataFrame(rows[:-1], "key long, ts timestamp"), "key", "ts", 260).collect()}
    assert want and {(r.key, r.since, r.until, r.seconds) for r in got if r.kind == "resumed"} == want
    assert sorted(str(r.key) for r in got if r.kind == "silent") == sorted(str(k) for k in [w[0] for w in want] + [None, *[big + i for i in range(1, 7)]])


def test_categories_are_marked_over_runs(spark, tmp_path):
    """Thousands of items in two runs (F8): a category is marked once its last item is settled, by a state that no Python call holds."""
    path, schema = str(tmp_path / "t"), "cat long, sid long, k int"
    for run in (1, 2):
        e = spark.range(4_000).selectExpr("id div 4 as cat", "id as sid", "cast(id % 3 as int) as k")
        e.where(F.col("sid") % 2 == run - 1).write.mode("append").parquet(str(tmp_path / "in"))
        found = keyed.retry_stream(incremental.file_stream(spark, str(tmp_path / "in"), schema, 100), ["cat", "sid"], F.col("k") < run, "k", path, str(tmp_path / "ck"))
        found.awaitTermination(60)
        assert found.lastProgress["stateOperators"] == []
    marked = {r.cat: r.done for r in keyed.marked_categories(e, keyed.settled(spark, path), ["cat"], ["cat", "sid"]).collect()}
    assert marked == {c: all(i % 3 < 2 for i in range(4 * c, 4 * c + 4)) for c in range(1_000)}


def test_items_settled_more_than_once(spark, tmp_path):
    """Items that are forgotten are tried anew: one that is settled twice counts once in its category, one that fails then waits; a missing key is a key (F8)."""
    path = str(tmp_path / "t")

    def run(rows, kept):
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = incremental.file_stream(spark, str(tmp_path / "in"), ITEMS, 100)
        keyed.retry_stream(stream, ["cat", "sid"], F.col("k") == 0, "seq", path, str(tmp_path / "ck"), most=3, kept=kept).awaitTermination(60)
        return sorted((r.cat or "", r.sid or "", r.seq, r.attempt, r.status) for r in keyed.waiting(spark, path, ["cat", "sid"]).collect())

    assert run([("a", "1", 1, 0), ("a", None, 1, 1), ("b", "1", 1, 0), (None, "1", 1, 1), ("c", "1", 1, 1)], 90) == [("", "1", 1, 1, "retry"), ("a", "", 1, 1, "retry"), ("c", "1", 1, 1, "retry")]
    assert run([("a", None, 2, 0), (None, "1", 2, 0)], 90) == [("c", "1", 1, 2, "retry")]
    assert run([("a", "1", 2, 0), ("b", "1", 2, 5)], 0) == [("b", "1", 2, 1, "retry"), ("c", "1", 1, 1, "retry")]
    assert sorted((r.cat or "", r.sid or "") for r in keyed.settled(spark, path).collect()) == [("", "1"), ("a", ""), ("a", "1"), ("a", "1"), ("b", "1")]
    items = spark.createDataFrame([("a", "1"), ("a", None), ("b", "1"), (None, "1"), ("c", "1"), ("c", "2")], "cat string, sid string")
    keys = ["cat", "sid"]
    for rows, b_done in ((keyed.settled(spark, path), True), (keyed.settled(spark, path, keys), False)):
        marked = {r.cat: (r["items"], r.done) for r in keyed.marked_categories(items, rows, ["cat"], keys).collect()}
        assert marked == {"a": (2, True), None: (1, True), "b": (1, b_done), "c": (2, False)}
