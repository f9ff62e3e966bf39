"""Where tables and files that a query makes for itself are put."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made so far, until clean_up.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without that setting: it gets a
    temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shelfwright-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def staging_dir(spark: SparkSession) -> str:
    """A new folder below shared_dir."""
    _made.append(f"{shared_dir(spark)}/shelfwright-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame) -> DataFrame:
    """Write df to a folder of its own and read it again, so that it is worked out once."""
    path = staging_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> int:
    """Delete the folders made by this process, and say how many there were. For when all results have been written elsewhere: a DataFrame that
    reads one of them can't be run afterwards."""
    n = len(_made)
    while _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
