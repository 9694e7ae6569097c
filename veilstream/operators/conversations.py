"""Secrets split over the turns of a conversation: windows of the last turns, scanned with and without spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS, TTL_SECONDS, MOST_TURNS = 3, 1800, 64
#: Rules whose findings hold signs: a window is of letters, digits and single spaces.
MARKED = ("solana-keypair", "substrate-secret-uri", "cardano-signing-key", "keystore-json", "pem-private-key")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^\\p{L}\\p{N}]+", " "))


def windows(turns: DataFrame, n: int = TURNS, ttl: int = TTL_SECONDS, conv: str = "conv_id", turn: str = "turn", text: str = "text", ts: str | None = None) -> DataFrame:
    """turns with `window`: its text and the up to n - 1 before it, normalised, oldest first.

    Blank conversations and turns without letters or digits take no slot. With a time column, turns older than
    `ttl` seconds at the time of the current one are left out. n <= 0 and ttl <= 0 stand for the defaults.
    """
    n, ttl = min(n if n > 0 else TURNS, MOST_TURNS), ttl if ttl > 0 else TTL_SECONDS
    rows = turns.withColumn("_norm", normalised(F.coalesce(F.col(text), F.lit("")))).where((F.col("_norm") != "") & (F.trim(F.col(conv).cast("string")) != ""))
    w = Window.partitionBy(conv).orderBy(*([ts] if ts else []), turn).rowsBetween(-(n - 1), 0)
    if ts:
        held = F.collect_list(F.struct(F.col(ts).alias("at"), F.col("_norm").alias("norm"))).over(w)
        rows = rows.withColumn("_held", held)
        live = F.filter("_held", lambda x: x["at"] > F.col(ts) - F.make_interval(secs=F.lit(ttl)))
        return rows.withColumn("window", F.array_join(F.transform(live, lambda x: x["norm"]), " ")).drop("_norm", "_held")
    return rows.withColumn("window", F.array_join(F.collect_list("_norm").over(w), " ")).drop("_norm")


def cross_turn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", wordlist: DataFrame | None = None, **options) -> DataFrame:
    """(conv, turn, blocked, critical_entities): certain secrets in a window, as it is or without its spaces."""
    from ..plans.inspection import detect_each

    rows = windows(turns, conv=conv, turn=turn, **options)
    # both variants stay in the row of their turn; each is searched where it stands
    rows = rows.withColumn("_joined", F.regexp_replace("window", "\\s+", "")).select(conv, turn, "window", "_joined")
    found = detect_each(rows, {"_found": ("window", wordlist), "secrets": ("_joined", None)}, fields=False, skip=MARKED)
    types = F.transform(F.filter(F.concat("_found", "secrets"), lambda x: x["risk_level"] == "CRITICAL"), lambda x: x["entity_type"])
    types = F.when((F.size("_found") > 0) | (F.size("secrets") > 0), F.array_sort(F.array_distinct(types))).otherwise(F.array().cast("array<string>"))
    return found.select(conv, turn, types.alias("critical_entities")).select(conv, turn, (F.size("critical_entities") > 0).alias("blocked"), "critical_entities")
