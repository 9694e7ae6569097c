"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w: u comes from a hash of its id, w is its quality weight. Within a source,
documents in order of that key are a weighted sample without replacement. A source's target is met by complete
epochs first; the rest is the shortest run of the sorted documents whose sizes come to the budget. Only the one
key bucket of a source in which the budget ends is ever sorted, so a source with a third of all rows costs one
bucket, not one task for the whole.

Defined results: a null text has size 0 and is never taken. A null source is a source of its own, last in order.
Rows that repeat a document count each time, and rows without id are rows like others; ties of key go by doc_id, then
by size, so reruns agree. A very long text is taken whole or not at all. An empty table gives an empty result. With a
total of 0 all targets are 0. All columns pass through `mix_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, text_of, words_of

#: Weights of sources in order of their code points, repeating.
SOURCE_WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes.
TOTAL_SHARE = 1.5
#: A target is at most this many times its source's size.
MAX_EPOCHS = 2.0
#: Quality weight of documents labelled good, labelled bad, and without a label.
LABEL_WEIGHTS = (2.0, 0.5, 1.0)
#: Key buckets of a source; each holds about this part of its rows.
KEY_BUCKETS = 4096
#: A table of sources, or of weights, up to this many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_SOURCES, BROADCAST_WEIGHTS = 100_000, 500_000


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: tuple = SOURCE_WEIGHTS, share: float = TOTAL_SHARE, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target): shares by weight, none above cap x its size, the excess shared anew by weight.

    Sharing the excess until none is above ends at a water level L with target = least(cap * size, L * weight):
    sources by their cap / weight fill up in that order, so L follows from running sums over the table of sources.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights)).cast("int") + 1)
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_fills", F.col("_cap") / F.col("_w"))
    every = Window.orderBy("_fills", F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    # the level if every source before this one is full and none from here on
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    per = per.withColumn("_level", F.when(level <= F.col("_fills"), level))
    # the first such level, which is also the highest, holds; where there is none, every source is full
    per = per.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    return per.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """-ln(u) / weight, u in (0, 1] from a hash of the id: the larger the weight, the earlier on average."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("mix")), 11).cast("double") + 1.0) / F.lit(float(2**53))
    return -F.log(u) / weight


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", quality: DataFrame | None = None, buckets: int = KEY_BUCKETS, carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs; with carry, also the row itself as a struct `row`.

    quality: (doc_id, weight > 0); documents without a row there weigh 1.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), F.size(words_of(text_of(text))).cast("long").alias("size"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    if quality is not None:
        weights = quality.groupBy("doc_id").agg(F.max("weight").alias("_weight"))
        rows = rows.join(F.broadcast(weights) if quality.count() <= BROADCAST_WEIGHTS else weights, "doc_id", "left")
    else:
        rows = rows.withColumn("_weight", F.lit(1.0))
    rows = materialize(rows.withColumn("_key", sampling_key(F.col("doc_id"), F.coalesce(F.col("_weight"), F.lit(1.0)))).drop("_weight"), "mix-rows")
    # 1 - exp(-key) is monotone in the key and spreads over (0, 1)
    rows = rows.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    targets = materialize(source_targets(rows), "mix-targets")
    # the bucket of each source in which the part of an epoch ends
    per_bucket = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")).withColumnRenamed("source", "_s").join(F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets, F.col("_s").eqNullSafe(F.col("source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    per_bucket = per_bucket.withColumn("_epochs", epochs).withColumn("_part", F.col("target") - F.col("_epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = per_bucket.withColumn("_upto", F.sum("_sum").over(upto))
    plan = per_bucket.groupBy("source", "source_size", "target", "_epochs", "_part").agg(
        F.min(F.when(F.col("_upto") >= F.col("_part"), F.col("_bucket"))).alias("_last"),
        F.coalesce(F.max(F.when(F.col("_upto") < F.col("_part"), F.col("_upto"))), F.lit(0)).alias("_full"),
    ).withColumnRenamed("source", "_of")
    plan = materialize(plan, "mix-plan")
    rows = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    edge = rows.where(F.col("_bucket") == F.col("_last"))
    inner = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # at the edge a document is taken if that brings the sum nearer to the budget
    edge = edge.withColumn("_before", F.col("_full") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    edge = edge.withColumn("_more", F.col("_before") + F.col("size") / 2 <= F.col("_part")).drop("_before")
    other = rows.where((F.col("_bucket") != F.col("_last")) | F.col("_last").isNull()).withColumn("_more", F.col("_last").isNull() | (F.col("_bucket") < F.col("_last")))
    rows = other.unionByName(edge)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("_epochs") + F.col("_more").cast("long"))).alias("taken"), *(["row"] if carry else []))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels (doc_id, quality)."""
    good, bad, none = LABEL_WEIGHTS
    return labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, good).when(F.col("quality") == 0, bad).otherwise(none)).alias("weight"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", quality: DataFrame | None = None) -> DataFrame:
    """The mixed corpus: each row of docs as many times as the mix takes it, with its columns."""
    took = mix(docs, id_col, source, text, quality, carry=True).where("taken > 0")
    return took.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.expr("taken div size")))).select("row.*")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the mix of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, quality=label_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken", "source")


__all__ = ["label_weights", "mix", "mix_documents", "op9_mixing", "source_targets"]
