"""Helpers shared by the training-data operators."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staging_dir

#: Rows in one Arrow batch. Documents can be long, so batches are kept small.
BATCH_ROWS = 500


def save(df: DataFrame) -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again. sources.staging.clean_up removes what was written."""
    path = staging_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each context."""
    context = spark.sparkContext
    if not getattr(context, "_shelfwright_sent", False):
        root = Path(__file__).resolve().parents[2]
        target = tempfile.mkdtemp(prefix="spark-shelfwright-")
        stage = Path(target, "stage")
        shutil.copytree(root / "shelfwright", stage / "shelfwright", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{target}/shelfwright", "zip", stage))
        context._shelfwright_sent = True


def map_arrow(df: DataFrame, func, schema) -> DataFrame:
    """mapInArrow with batches that stay small when texts are long. The batch size is a setting of the session, which stays lowered: it is
    read when the plan runs."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)
    return df.mapInArrow(func, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null gives the empty text."""
    column = batch.column(name).cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns can't clash with its own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component = smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then jumps along labels, so the
    number of rounds grows with the logarithm of the longest path. All state is a written table.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    both = save(both.union(both.select("v", "u")).distinct())
    label = save(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).select(F.col("u").alias("node"), "l"))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        # hook a node's current root on the smallest label that any member sees
        seen = label.join(near.select(F.col("u").alias("node"), "m"), "node")
        hook = seen.groupBy("l").agg(F.min("m").alias("m")).select(F.col("l").alias("root"), F.least("root", "m").alias("to"))
        step = label.join(hook, F.col("l") == F.col("root"), "left").select("node", "l", F.least("l", F.coalesce("to", "l")).alias("n"))
        step = save(step)
        jump = step.select(F.col("node").alias("jn"), F.col("n").alias("jl"))
        new = save(step.join(jump, F.col("n") == F.col("jn"), "left").select("node", "l", F.least("n", F.coalesce("jl", "n")).alias("n")))
        moved = new.where("l <> n").limit(1).count()
        label = new.select("node", F.col("n").alias("l"))
        if not moved:
            return label.select("node", F.col("l").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
