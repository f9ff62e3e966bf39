"""Incremental ingest on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """T2. A folder of Parquet files as a stream, a few files at a time, so that a restart has little to do again."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def unseen(stream: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """T1. Rows with keys not seen before. With an event time the state is dropped behind the watermark; without one it grows with
    the number of keys."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def without_done(items: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """J12. Items that no earlier run has processed."""
    return items.join(done.select(*keys), keys, "left_anti")


#: Parts of a table that upsert_stream keeps; a batch rewrites those that its keys fall into.
BUCKETS, BUCKET = 64, "upsert_bucket"


def upsert_stream(stream: DataFrame, key: list[str], sequence: str, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """T2, T3, T6. Each batch is merged into the table at `path`: the latest row of each key by `sequence` stays, a late older one is
    refused. Keys are dealt into buckets; a batch writes a new version of the buckets it touches, and versions that no
    restart can ask for any more are removed. A restart in between does the batch again with the same result."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # `buckets` rows at most
        old = read_version(spark, path, before=number, only=touched)
        both = batch if old is None else old.unionByName(batch)
        last = Window.partitionBy(*key).orderBy(F.desc(sequence), *[F.desc(c) for c in batch.columns if c not in (*key, sequence)])
        kept = both.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn").withColumn(BUCKET, bucket)
        kept.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/v={number}")
        batch.unpersist()
        drop_versions(spark, path, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _file_system(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, folder) of every bucket of every complete version."""
    hadoop, fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, _file_system(spark, path)
    if not fs.exists(hadoop(path)):
        return []
    out = []
    for s in fs.listStatus(hadoop(path)):
        if s.getPath().getName().startswith("v=") and fs.exists(hadoop(s.getPath(), "_SUCCESS")):
            out += [(int(s.getPath().getName()[2:]), x.getPath().toString()) for x in fs.listStatus(s.getPath()) if x.getPath().getName().startswith(BUCKET)]
    return out


def _latest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The folder of each bucket's latest version."""
    out: dict[int, str] = {}
    for version, folder in sorted(_folders(spark, path)):
        if before is None or version < before:
            out[int(folder.rsplit("=", 1)[1])] = folder
    return out


def read_version(spark: SparkSession, path: str, before: int | None = None, only: set[int] | None = None) -> DataFrame | None:
    """The table of upsert_stream as it is, or as it was before a batch; `only` some of its buckets. None where there is nothing."""
    found = [folder for bucket, folder in _latest(spark, path, before).items() if only is None or bucket in only]
    return spark.read.parquet(*found) if found else None


def drop_versions(spark: SparkSession, path: str, number: int) -> None:
    """Remove the versions of buckets that no repetition of this batch reads."""
    keep = set(_latest(spark, path, number).values())
    for version, folder in _folders(spark, path):
        if version < number and folder not in keep:
            _file_system(spark, folder).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def split_failures(rows: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """T3. Rows to go on with, and rows for the dead-letter table, from which they are tried again."""
    ok = F.coalesce(good, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def stalls(beats: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """T4 in batch. Silences of a key longer than the gap: (key, since, until, seconds)."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    rows = beats.select(key, before.alias("since"), F.col(ts).alias("until"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("until") - micros("since")) / 1_000_000
    return rows.withColumn("seconds", seconds).where(F.col("seconds") > gap_seconds)


def attempts(beats: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """T4 with session windows, for batch and stream alike: a session ends where the key is silent for longer than the gap."""
    return beats.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("beats")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "beats")


def attempt_numbers(sessions: DataFrame, key: str, most: int) -> DataFrame:
    """T4. Each session's running number, and whether it is past the allowed restarts."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return sessions.withColumn("attempt", n).withColumn("given_up", F.col("attempt") > most)


def completed(lines: DataFrame, run: str, text: str, marker: str) -> DataFrame:
    """T5. Whether each run's log holds the completion marker."""
    return lines.groupBy(run).agg(F.max(F.col(text).rlike(marker)).alias("complete"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there, then stop."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
