"""A log of audit events as a partitioned table that a batch can be written to again without leaving two copies.

Events lie in folders by day and batch. Writing a batch first deletes what an earlier try of it left, on whatever day.
Whoever reads while a batch is written again may miss that batch, but never sees an event twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: days that events are kept.
RETENTION_DAYS = 180


@dataclass(frozen=True)
class AuditLog:
    """path: a folder that driver and executors share. stream: tells apart the streams that write here."""

    path: str
    stream: str = "audit"

    def _delete(self, spark: SparkSession, pattern: str, goes=lambda name: True) -> int:
        """Deletes the folders that match a pattern below the path; how many."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.globStatus(at) or []]
        return sum(bool(files.delete(p, True)) for p in found if goes(p.getName()))

    def write(self, events: DataFrame, batch: int, day: Column | None = None) -> None:
        """Writes a batch's events, in place of those that it wrote before. day: a date; today unless given."""
        self._delete(events.sparkSession, f"day=*/stream={self.stream}/batch={batch}")
        rows = events.withColumns({"day": F.current_date() if day is None else day, "stream": F.lit(self.stream), "batch": F.lit(batch).cast("long")})
        rows.write.partitionBy("day", "stream", "batch").mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All events, with day, stream and batch. A log without any event fails as a missing table does."""
        return spark.read.parquet(self.path)

    def drop_before(self, spark: SparkSession, day: str) -> int:
        """Deletes the events of all days before the one given (yyyy-mm-dd); how many days."""
        return self._delete(spark, "day=*", lambda name: name.removeprefix("day=") < day)

    def retain(self, spark: SparkSession, days: int = RETENTION_DAYS) -> int:
        """Deletes events older than so many days; how many days of them."""
        first = spark.range(1).select(F.date_sub(F.current_date(), days).cast("string")).first()[0]
        return self.drop_before(spark, first)
