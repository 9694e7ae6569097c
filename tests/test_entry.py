"""The entry point works with and without the optional parts; some queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from veilstream.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["pii_email_spans", "evm_key_hex", "span_merge_type", "policy_decide", "inspect_documents", "audit_events", "cross_turn_block", "json_secret_scan", "bip39_runs", "mixed_findings", "own_policy", "stellar_seeds", "conversation_ttl", "conversation_cap", "han_runs", "audit_lines", "settings_inspect", "scan_limit", "acceptance_types", "provider_verdicts", "mnemonic_any_id", "inspect_json", "own_rule", "conversation_stream", "conversation_late", "audit_log", "acceptance_report"]


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in cur.fetchall())
