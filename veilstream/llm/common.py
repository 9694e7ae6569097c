"""What the training-data operators share: texts, shared storage, running totals, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space that parts words, as a class of Java's regular expressions.
SPACES = "[\\x20\\x09-\\x0D]+"
#: Bytes: A-Z to lower case.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes: A-Z to lower case; ASCII other than letters and digits to a space.
WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).translate(LOWER_BYTES)
#: The most bytes of a record batch for Python in intermediate steps, about, and the setting for it.
ARROW_BYTES, ARROW_LIMIT = 8_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation.

    While it is written, record batches for Python are kept to ARROW_BYTES.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_LIMIT, None)
    try:
        spark.conf.set(ARROW_LIMIT, str(ARROW_BYTES))
        df.write.parquet(at)
    finally:
        spark.conf.unset(ARROW_LIMIT) if before is None else spark.conf.set(ARROW_LIMIT, before)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize wrote, once all that was made of them is written too."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_of(c: str | Column) -> Column:
    """The text as a string that isn't null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def words_of(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text that isn't null."""
    return F.filter(F.split(c, SPACES, -1), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, and only when the whole is."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list, weight: str, name: str) -> DataFrame:
    """Adds `name`: the sum of weight over the rows before this one within keys, ordered by (bucket, *order).

    Totals by bucket are summed first, so no task sorts more than one bucket of a key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(k).alias(f"_k_{k}") for k in [*keys, bucket]), F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_start"))
    on = F.lit(True)
    for k in [*keys, bucket]:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, on).withColumn(name, F.col("_start") + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("_start", *(f"_k_{k}" for k in [*keys, bucket]))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); component is the smallest node reachable.

    Alternating large-star and small-star steps until nothing moves; each ends in the shared folder. Hubs are found
    by an aggregate and joined back, so a node with very many neighbours is a skewed join that Spark splits, not one
    group. Self-loops are allowed; an empty table gives no rows.
    """
    state = materialize(edges.select(F.greatest("a", "b").cast("long").alias("v"), F.least("a", "b").cast("long").alias("m")).distinct(), "edges")
    last = None
    while True:
        # large star: every larger neighbour of a node moves to the smallest neighbour
        both = state.select(F.col("v").alias("u"), F.col("m").alias("n")).union(state.select(F.col("m").alias("u"), F.col("v").alias("n")))
        low = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.where("n > u").join(low, "u").select(F.col("n").alias("v"), "m").union(low.select(F.col("u").alias("v"), "m")).distinct()
        # small star: every smaller neighbour of a node moves to the smallest of them
        low = large.groupBy("v").agg(F.min("m").alias("to"))
        small = large.where("m < v").join(low, "v").select(F.col("m").alias("v"), F.col("to").alias("m")).union(low.select("v", F.col("to").alias("m"))).distinct()
        before, state = state, materialize(small, "stars")
        discard(before)
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        if now == last:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("m").alias("component"))
        last = now
