"""Queries of streams whose keys have state: items that are tried again, silences that are told."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staging_dir
from ..streaming import incremental, keyed
from .registry import query
from .tables import table

_ITEMS = "items AS (SELECT event_id, event_id // 4 AS cat, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS first, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS k FROM events)"
_TRIED = """tried AS (SELECT *, CASE WHEN k < first THEN 1 WHEN k < first + 1 AND first + 1 <= 3 THEN 2 WHEN k < first + 2 AND first + 2 <= 3 THEN 3 ELSE least(3, 4 - first) END AS attempt,
    CASE WHEN k < 3 THEN 'good' WHEN first = 1 THEN 'refused' ELSE 'retry' END AS status FROM items)"""


def _three_runs(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Events in two deliveries, read in three runs; run r can read items with k < r. An item is tried three times at most."""
    path = staging_dir(spark)
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("cat"), "event_id", (F.get_json_object("props", "$.k").try_cast("bigint") % 4).alias("k"))
    for run in (1, 2, 3):
        if run < 3:
            e.where(F.col("event_id") % 2 == run - 1).write.mode("append").parquet(f"{path}/in")
        stream = incremental.file_stream(spark, f"{path}/in", e.schema, 1000)
        keyed.retry_stream(stream, ["cat", "event_id"], F.col("k") < run, "k", f"{path}/items", f"{path}/state", most=3).awaitTermination()
    return e, f"{path}/items"


@query(f"WITH {_ITEMS}, {_TRIED} SELECT event_id, CAST(attempt AS BIGINT) AS attempt, status FROM tried")
def dead_letter_cycle(spark: SparkSession, d: str) -> DataFrame:
    """T3. Both halves: items that are good or refused, and items that wait for another attempt, with the number of attempts."""
    _, path = _three_runs(spark, d)
    both = keyed.settled(spark, path).unionByName(keyed.waiting(spark, path, ["cat", "event_id"]))
    return both.select("event_id", F.col("attempt").cast("bigint").alias("attempt"), "status")


@query(f"WITH {_ITEMS}, {_TRIED} SELECT cat, count(*) AS items, bool_and(status <> 'retry') AS done FROM tried GROUP BY cat")
def marked_categories(spark: SparkSession, d: str) -> DataFrame:
    """T3. Categories of four items each; one with an item that waits is not marked."""
    e, path = _three_runs(spark, d)
    return keyed.marked_categories(e, keyed.settled(spark, path), ["cat"], ["cat", "event_id"])


@query(
    """WITH b AS (SELECT user_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT user_id, count(*) FILTER (WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) > 21600000000) AS silent, count(*) FILTER (WHERE epoch_us(ts) - epoch_us(before) > 21600000000) AS resumed,
        coalesce(round(max((epoch_us(ts) - epoch_us(before)) / 1e6) FILTER (WHERE epoch_us(ts) - epoch_us(before) > 21600000000), 3), 0) AS longest FROM b GROUP BY user_id"""
)
def stream_stalls(spark: SparkSession, d: str) -> DataFrame:
    """T4 on a stream: events in four deliveries, by time; silences of six hours are told, also the last one of each user."""
    path = staging_dir(spark)
    e = table(spark, d, "events").select("user_id", "ts")
    end = e.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts")).select(F.lit(-1).cast(e.schema["user_id"].dataType).alias("user_id"), "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = [r[0] for r in e.agg(F.percentile_approx(at, [0.25, 0.5, 0.75]).alias("q")).selectExpr("explode(q)").collect()]
    parts = [e if low is None else e.where(at > low) for low in [None, *edges]]
    parts = [some if high is None else some.where(at <= high) for some, high in zip(parts, [*edges, None])]
    for some in [*parts, end]:  # a run each, so that a delivery of many files is one batch
        some.coalesce(64).write.mode("append").parquet(f"{path}/in")
        stream = keyed.stall_stream(incremental.file_stream(spark, f"{path}/in", end.schema, 1_000), ["user_id"], "ts", 21_600, "1 minute")
        keyed.start(stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True), spark).awaitTermination()
    found = spark.read.parquet(f"{path}/out").where("user_id <> -1").groupBy("user_id")
    return found.agg(F.count_if(F.col("kind") == "silent").alias("silent"), F.count_if(F.col("kind") == "resumed").alias("resumed"), F.coalesce(F.round(F.max(F.when(F.col("kind") == "resumed", F.col("seconds"))), 3), F.lit(0.0)).alias("longest"))
