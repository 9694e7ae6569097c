"""Settings and what they switch; the request of an event; answers of services."""

import json

import pytest
from pyspark.sql import functions as F

from veilstream.plans import configured, inspection
from veilstream.sources import providers, settings

KEY = "private key: 0x" + "ab" * 32


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(0, "call 13800000000 now"), (1, KEY), (2, None), (3, "value " + "ab" * 32), (4, "plain")], "doc_id long, text string")


def actions(df):
    return [r["action"] for r in df.orderBy("doc_id").collect()]


def test_sources_of_settings(spark, tmp_path):
    assert settings.from_mapping({}) == settings.Settings()
    nested = settings.from_mapping({"window": {"turns": "5", "ttl-seconds": 60}, "secret": {"languages": "english, chinese"}, "pii_enabled": "False"})
    assert (nested.window_turns, nested.window_ttl_seconds, nested.secret_languages, nested.pii_enabled) == (5, 60, ("english", "chinese"), False)
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"audit": {"enabled": False}, "pii": {"min_score": 0.7, "allowed-types": []}}))
    read = settings.from_file(spark, str(path))
    assert not read.audit_enabled and read.pii_min_score == 0.7 and read.pii_allowed_types == ()
    spark.conf.set("spark.veil.window_turns", "7")
    try:
        assert settings.from_session(spark).window_turns == 7
    finally:
        spark.conf.unset("spark.veil.window_turns")
    for wrong in ({"nothing": 1}, {"pii_enabled": "maybe"}, {"window_turns": "many"}, {"window_turns": None}):
        with pytest.raises(ValueError):
            settings.from_mapping(wrong)


def test_what_settings_switch(spark, rows):
    run = lambda **values: configured.inspect(rows, settings.from_mapping(values), pepper="p")
    assert actions(run()) == ["MASK", "BLOCK", "ALLOW", "ALLOW", "ALLOW"]
    assert actions(run(secret_hex_context_required=False))[3] != "ALLOW"
    assert actions(run(pii_enabled=False))[0] == "ALLOW"
    assert actions(run(secret_enabled=False))[1] == "ALLOW"
    assert actions(run(max_chars=8)) == ["ALLOW"] * 5
    off = run(enabled=False)
    assert actions(off) == ["ALLOW"] * 5 and off.where("doc_id = 1").first()["sanitized_text"] == KEY
    assert set(off.columns) == set(run().columns)
    assert configured.audit_events(off, settings.Settings()).count() == 0
    assert configured.audit_events(run(), settings.Settings()).count() == 2
    assert configured.audit_events(run(), settings.from_mapping({"audit_enabled": False})).count() == 0
    assert actions(configured.inspect(rows.limit(0), settings.Settings(), pepper="p")) == []


def test_scan_limit_masks_in_place(spark, rows):
    out = inspection.inspect(rows.where("doc_id = 0"), pepper="p", max_chars=16).first()
    assert out["sanitized_text"] == "call [PII:PHONE] now" and "_seen" not in out.asDict()


def test_providers_that_are_off_arent_called(spark):
    assert configured.provider_findings(settings.Settings(), F.col("text")) == []
    on = settings.from_mapping({"pii_provider_enabled": True, "injection_enabled": True, "injection_provider_enabled": True})
    assert len(configured.provider_findings(on, F.col("text"))) == 2


def test_windows_by_settings(spark):
    half = "ab" * 16
    turns = spark.createDataFrame([("c", 1, "private key 0x" + half), ("c", 2, "so"), ("c", 3, half)], "conv_id string, turn long, text string")
    blocked = lambda **values: [r["blocked"] for r in configured.cross_turn(turns, settings.from_mapping(values)).orderBy("turn").collect()]
    assert blocked(window_turns=2) == [False, False, False]
    assert blocked(window_enabled=False) == [False, False, False]


def test_context(spark, rows):
    given = inspection.with_context(rows, source=F.lit("chat"), trace_id=F.col("doc_id"), attributes=F.create_map(F.lit("a"), F.lit("b")))
    event = inspection.audit_events(inspection.inspect(given, pepper="p")).where("doc_id = 1").first()
    assert (event["source"], event["trace_id"], event["user_id"], event["elapsed_ms"]) == ("chat", "1", None, None)
    bare = inspection.audit_events(inspection.inspect(rows, pepper="p"))
    line = inspection.audit_lines(bare).where("doc_id = 1").first()["line"]
    assert line.startswith("guard-event direction=USER_INPUT source=null entityType=PRIVATE_KEY_HEX riskLevel=CRITICAL action=BLOCK ") and line.endswith(" traceId=null conversationId=null userId=null")
    assert "ab" * 8 not in line


def test_verdicts(spark):
    answers = ['{"is_valid": false, "scanners": {"x": 0.5}, "sanitized_prompt": "s"}', "{}", "broken", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "id int, answer string")
    out = [r["v"] for r in df.select("id", providers.verdicts(F.col("answer")).alias("v")).orderBy("id").collect()]
    assert [(v["valid"], dict(v["scanners"]), v["sanitized"]) for v in out] == [(False, {"x": 0.5}, "s"), (True, {}, None), (True, {}, None), (True, {}, None)]


def test_expected_types(spark):
    df = spark.sql("SELECT array('A', 'B') AS f, array('A') AS some, array('C') AS other, cast(array() AS array<string>) AS none")
    out = df.select(*(configured.holds(F.col(a), F.col(b)) for a, b in (("f", "some"), ("f", "other"), ("f", "none"), ("none", "none")))).first()
    assert list(out) == [True, False, False, True]
