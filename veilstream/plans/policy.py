"""Policy: which action a finding calls for, by entity type and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIRECTIONS = ["USER_INPUT", "MODEL_INPUT", "MODEL_OUTPUT", "TOOL_INPUT", "TOOL_OUTPUT", "RAG_DOCUMENT", "RAG_QUERY", "TRACE_PERSIST", "SNAPSHOT_PERSIST", "MEMORY_PERSIST", "EXTERNAL"]
PERSISTED = ["TRACE_PERSIST", "SNAPSHOT_PERSIST", "MEMORY_PERSIST"]
#: Types that hold a private key, in any form.
KEYS = ["MNEMONIC", "PRIVATE_KEY_HEX", "PRIVATE_KEY_WIF", "EXTENDED_PRIVATE_KEY", "SOLANA_KEYPAIR", "SUI_PRIVKEY", "BLOCKCHAIN_SUBSTRATE_SECRET_URI", "CARDANO_SIGNING_KEY", "STELLAR_SECRET_SEED", "KEYSTORE_JSON", "PEM_PRIVATE_KEY"]
SECRETS = ["API_KEY", "PASSWORD", "JWT"]
IDENTIFIERS = ["ADDRESS", "TX_HASH"]
ENTITIES = [*KEYS, "EXTENDED_PUBLIC_KEY", *IDENTIFIERS, *SECRETS, "PII", "PROMPT_INJECTION"]
FALLBACK = "MASK"
#: From mildest to strictest.
ACTIONS = ["ALLOW", "REVIEW", "MASK", "BLOCK"]


def default_action(entity: str, direction: str) -> str:
    kept = direction in PERSISTED
    if entity in KEYS:
        return "BLOCK"
    if entity in SECRETS:
        return "MASK" if kept else "BLOCK"
    if entity == "EXTENDED_PUBLIC_KEY":
        return "MASK" if kept or direction == "MODEL_OUTPUT" else "ALLOW"
    if entity in IDENTIFIERS:
        return "MASK" if kept else "ALLOW"
    return "MASK"


def default_policy(spark: SparkSession) -> DataFrame:
    """(entity_type, direction, action) for every type and direction."""
    return spark.createDataFrame([(e, d, default_action(e, d)) for e in ENTITIES for d in DIRECTIONS], "entity_type string, direction string, action string")


def hard_rule(entity: Column, risk: Column) -> Column:
    """A certain private key is blocked, whatever the policy says."""
    return (risk == "CRITICAL") & entity.isin(KEYS)


def severity(action: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ACTIONS)), action), F.lit(0)).cast("int")


def decide(findings: DataFrame, policy: DataFrame, fallback: str = FALLBACK) -> DataFrame:
    """Adds `action` to a table of findings (entity_type, risk_level, direction, ...). The policy is a small dimension table."""
    small = policy.select("entity_type", "direction", F.col("action").alias("_action"))
    small = F.broadcast(small) if policy.count() <= 100_000 else small
    joined = findings.join(small, ["entity_type", "direction"], "left")
    return joined.withColumn("action", F.when(hard_rule(F.col("entity_type"), F.col("risk_level")), "BLOCK").otherwise(F.coalesce("_action", F.lit(fallback)))).drop("_action")


def decider(policy: DataFrame | None, fallback: str = FALLBACK, most: int = 10_000):
    """action(entity, direction, risk) as a Column function, for findings that stay inside a row.

    A policy table is read by the driver; it has a row for each type and direction, and fails above `most` rows.
    """
    if policy is None:
        table = {(e, d): default_action(e, d) for e in ENTITIES for d in DIRECTIONS}
    else:
        rows = policy.select("entity_type", "direction", "action").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a policy has {most} rows at most")
        table = {(r["entity_type"], r["direction"]): r["action"] for r in rows}
    by_action: dict[str, list[str]] = {}
    for (entity, direction), action in table.items():
        by_action.setdefault(action, []).append(f"{entity}|{direction}")

    def action(entity: Column, direction: Column, risk: Column) -> Column:
        key = F.concat_ws("|", entity, direction)
        out = F.when(hard_rule(entity, risk), "BLOCK")
        for name, keys in by_action.items():
            if name != fallback:
                out = out.when(key.isin(keys), name)
        return out.otherwise(fallback)

    return action


def strictest(actions: Column) -> Column:
    """The strictest of an array of actions; ALLOW for none."""
    best = F.array_max(F.transform(actions, severity))
    return F.get(F.array(*map(F.lit, ACTIONS)), F.greatest(F.coalesce(best, F.lit(1)), F.lit(1)) - 1)
