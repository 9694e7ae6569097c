"""Tables of a folder, and their rows spread over the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, if the input has fewer splits than there are cores; else df itself.

    Searching texts takes far longer than moving them, so a small file that can't be split is worth one exchange. A
    table with more splits than cores, as any large one, isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a task that makes its texts from keys: such a task takes seconds.
TASK_ROWS = 20_000


def dealt(df: DataFrame) -> DataFrame:
    """Rows of a table without texts, dealt evenly over tasks of TASK_ROWS rows, and over all cores at least.

    A few bytes of keys become a text that takes far longer to search than to move, so the size of a file says nothing
    of the work. A file's rows may also lie in one row group, which can't be split. The rows are counted from footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // TASK_ROWS)))


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; below one of our own where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found}/{label}-{uuid.uuid4().hex}"
