"""Streams with state of their own for each key: items that are tried again, and silences that are told while nothing arrives."""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructField, StructType

from .incremental import BUCKET, BUCKETS, drop_versions, file_stream, read_version, run_available

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer: DataStreamWriter, spark: SparkSession, idle: bool = True) -> StreamingQuery:
    """Start a stream whose keys have state of their own: it needs Spark's RocksDB store. A stream with expiring state would ask for batches without
    data for ever; idle=False runs none, so that a run over what is there ends. A stream takes its settings when it starts; the session
    gets its own back."""
    names = {"spark.sql.streaming.stateStore.providerClass": STORE} | ({} if idle else {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def retry_stream(items: DataFrame, keys: list[str], good: Column, sequence: str, path: str, checkpoint: str, most: int = 3, kept: int = 90) -> StreamingQuery:
    """T3. One run over what has arrived. An item (keys) for which `good` doesn't hold is put into the dead-letter folder, which is a source
    of the next run: there it is tried again, with whatever `good` is then, until it has failed `most` times and is refused. An item
    that is settled - good or refused - is not tried again within `kept` days, however often it is delivered.

    Of a batch each item is tried once, in the form that is good, the latest of equals; items have a `sequence` column that is never null. Results are read
    by `settled` and `waiting`. What is known of an item lies in buckets of its key, as in `upsert_stream`: a batch joins the buckets it touches and
    writes them anew. Each batch writes its results as one folder; a batch that is repeated after a crash finds it complete and leaves it, so that no
    result is there twice.
    """
    spark, schema = items.sparkSession, items.schema
    dead = StructType([*schema.fields, *StructType.fromDDL("attempt int, status string").fields])
    for folder in ("waiting", "settled"):  # so that both can be read from the first run on
        if not _complete(spark, f"{path}/{folder}/start"):
            spark.createDataFrame([], dead).write.mode("overwrite").parquet(f"{path}/{folder}/start")
    again = file_stream(spark, f"{path}/waiting/*", dead, 1_000).select(*schema.names)
    judged = items.unionByName(again).withColumn("_ok", F.coalesce(good, F.lit(False)))
    rest = [c for c in schema.names if c not in keys]
    known = StructType([*[schema[k] for k in keys], *StructType.fromDDL("attempt int, status string, at bigint").fields])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target, now, bucket = f"{path}/tried/v={number}", int(time.time() * 1_000), F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        best = batch.groupBy(*keys).agg(F.max_by(F.struct("_ok", *rest), F.struct("_ok", sequence)).alias("_best")).persist()
        if not _complete(spark, target):
            touched = {r[0] for r in best.select(bucket).distinct().collect()}  # BUCKETS rows at most
            old = read_version(spark, f"{path}/tried", before=number, only=touched)
            old = (spark.createDataFrame([], known) if old is None else old.select(*known.names)).where(F.col("at") > now - kept * 86_400_000)
            both = _joined(old, best, keys)
            told = F.col("_best").isNotNull() & F.coalesce(F.col("status") == "retry", F.lit(True))
            n = F.coalesce("attempt", F.lit(0)) + 1
            status = F.when(F.col("_best._ok"), "good").when(n >= most, "refused").otherwise("retry")
            after = both.select(
                *keys, F.when(told, n).otherwise(F.col("attempt")).alias("attempt"), F.when(told, status).otherwise(F.col("status")).alias("status"),
                F.when(told, F.lit(now)).otherwise(F.col("at")).alias("at"), F.when(told, F.col("_best")).alias("_told"), bucket.alias(BUCKET),
            )
            after.repartition(BUCKETS, BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        told_schema = StructType([*known.fields, StructField("_told", best.schema["_best"].dataType)])
        tried = spark.read.schema(told_schema).parquet(target).where("_told is not null").select(*[F.col(c if c in keys else f"_told.{c}").alias(c) for c in schema.names], "attempt", "status")
        for folder, some in (("settled", F.col("status") != "retry"), ("waiting", F.col("status") == "retry")):
            if not _complete(spark, f"{path}/{folder}/v{number}"):
                tried.where(some).write.mode("overwrite").parquet(f"{path}/{folder}/v{number}")
        best.unpersist()
        drop_versions(spark, f"{path}/tried", number)

    return run_available(judged, write, checkpoint)


def _joined(old: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """What is known of items beside what has come, keys that are null included."""
    new = best.select(*[F.col(k).alias(f"_new_{k}") for k in keys], "_best", F.lit(True).alias("_came"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    both = old.join(new, on, "full")
    return both.select(*[F.when(F.col("_came"), F.col(f"_new_{k}")).otherwise(F.col(k)).alias(k) for k in keys], *[c for c in old.columns if c not in keys], "_best")


def _complete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def settled(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Items of retry_stream that are good or refused, with the number of attempts. Without keys there is a row for each time that an item was settled, since one
    that was forgotten is tried anew; with keys an item is there once, and only if its last attempt settled it."""
    return _last(spark, path, keys).where("status <> 'retry'") if keys else spark.read.parquet(f"{path}/settled/*")


def waiting(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Items of retry_stream that will be tried again, as their last attempt left them."""
    return _last(spark, path, keys).where("status = 'retry'")


def _last(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """What the last attempt on each item came to: that of the latest batch, whose number is in the folder's name."""
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/v([0-9]+)/[^/]*$", 1).try_cast("bigint").alias("_batch")
    both = [spark.read.parquet(f"{path}/{folder}/*").select("*", batch) for folder in ("settled", "waiting")]
    rows = both[0].unionByName(both[1])
    names = [c for c in rows.columns if c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in names if c not in keys]), "_batch").alias("_row"))
    return last.select(*[F.col(c if c in keys else f"_row.{c}").alias(c) for c in names])


def marked_categories(items: DataFrame, settled_items: DataFrame, category: list[str], keys: list[str]) -> DataFrame:
    """T3. (category, items, done): a category is marked only if none of its items waits for another attempt. An item counts once however often it is among the
    settled ones, and a missing key is a key."""
    known = settled_items.select(*[F.col(k).alias(f"_known_{k}") for k in keys], F.lit(True).alias("_settled")).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys])
    return items.join(known, on, "left").groupBy(*category).agg(F.count("*").alias("items"), F.bool_and(F.coalesce("_settled", F.lit(False))).alias("done"))


class Silences(StatefulProcessor):
    """A bucket of keys, as one frame (key, us, mark): the last beat of each key (0), one whose silence was told (1), and beats that the watermark has not passed
    yet, so their order is open (2). One timer stands for the bucket's next event."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "frame binary, due bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame, due = self.load()
        came = [pd.DataFrame({"key": r.iloc[:, 0], "us": r.iloc[:, 2], "mark": 2}) for r in rows]  # by place: names may be lost on the way
        self.keep(pd.concat([*([] if frame is None else [frame]), *came]), due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        frame, _ = self.load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ready = ((frame["us"] <= now) | (frame["mark"] < 2)).to_numpy()
        rest, frame = frame[~ready], frame[ready]
        frame = frame.iloc[np.lexsort((frame["mark"], frame["us"], pd.factorize(frame["key"])[0]))].reset_index(drop=True)
        since, before = frame["us"].shift(fill_value=0), frame["mark"].shift(fill_value=0)
        broke = (frame["key"] == frame["key"].shift()) & (frame["us"] - since > self.gap)
        last = frame[~frame["key"].duplicated(keep="last")]
        last = last.assign(mark=last["mark"] % 2)
        quiet = (last["mark"] == 0) & (now - last["us"] > self.gap)
        silent = broke & (before != 1)
        yield pd.concat([
            self.told(frame["key"][silent], "silent", since[silent], None), self.told(frame["key"][broke], "resumed", since[broke], frame["us"][broke]), self.told(last["key"][quiet], "silent", last["us"][quiet], None),
        ])
        self.keep(pd.concat([last.assign(mark=last["mark"].mask(quiet, 1)), rest]), None)

    def load(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self.kept.exists():
            return None, None
        data, due = self.kept.get()
        return pa.ipc.open_stream(data).read_pandas(), due

    def keep(self, frame: pd.DataFrame, due: int | None) -> None:
        """Store the frame; the timer is set to the first beat that waits or the first silence that may come."""
        at = (frame["us"] + np.where(frame["mark"] == 0, self.gap, 0))[frame["mark"] != 1]
        next_due = int(at.min()) // 1000 + 1 if len(at) else None
        if next_due != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if next_due is not None:
                self.handle.registerTimer(next_due)
        table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.kept.update((sink.getvalue().to_pybytes(), next_due))

    def told(self, keys: pd.Series, kind: str, since: pd.Series, until: pd.Series | None) -> pd.DataFrame:
        return pd.DataFrame({"_key": keys, "kind": kind, "since_us": since, "until_us": pd.Series(pd.NA if until is None else until, index=keys.index, dtype="Int64")})

    def close(self) -> None:
        pass


def stall_stream(beats: DataFrame, keys: list[str], ts: str, gap_seconds: int, delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """T4 on a stream: (keys, kind, since, until, seconds). A row 'silent' is told as soon as the watermark - moved on by other keys' beats -
    is over `gap_seconds` past a key's last beat; 'resumed' when it beats again, with the length of the silence, as in `incremental.stalls`. Beats may come out of order
    by up to `delay`; later ones are dropped. Keys are dealt into `buckets`, whose beats Python works off as whole columns; the number is
    fixed for a checkpoint. The stream is started by `start`."""
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    key = F.to_json(F.struct(*keys), exact)
    schema = StructType.fromDDL("_key string, kind string, since_us bigint, until_us bigint")
    marked = beats.where(F.col(ts).isNotNull()).select(key.alias("_key"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", delay).withColumn("_us", F.unix_micros("_ts"))
    dealt = marked.withColumn("_bucket", F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    found = dealt.groupBy("_bucket").transformWithStateInPandas(Silences(gap_seconds * 1_000_000), schema, "Append", "EventTime")
    found = found.withColumn("_k", F.from_json("_key", StructType([beats.schema[k] for k in keys]), exact))
    return found.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "kind", F.timestamp_micros("since_us").alias("since"), F.timestamp_micros("until_us").alias("until"), ((F.col("until_us") - F.col("since_us")) / 1_000_000).alias("seconds"))
