"""Merging, masking, decisions, audit, conversations, providers, structured texts."""

import hmac

from pyspark.sql import functions as F

from veilstream.functions import crypto, spans
from veilstream.operators import conversations, structured
from veilstream.plans import inspection, policy
from veilstream.sources import providers
from veilstream.streaming import conversations as stream


def _found(spark, rows):
    one = [(e, r, 0.5, s, n, f"r{i}", "") for i, (e, r, s, n) in enumerate(rows)]
    return spark.createDataFrame([(one,)], f"found {spans.FINDINGS}")


def _spans(df, merged):
    return [(f["entity_type"], f["risk_level"], f["start"], f["end"]) for f in df.select(merged).first()[0]]


def test_merge(spark):
    df = _found(spark, [("A", "LOW", 2, 8), ("A", "LOW", 2, 4), ("A", "LOW", 5, 9)])
    assert _spans(df, spans.merge(F.col("found"))) == [("A", "LOW", 2, 9)]
    df = _found(spark, [("A", "LOW", 0, 10), ("B", "CRITICAL", 3, 12)])
    assert _spans(df, spans.merge(F.col("found"))) == [("B", "CRITICAL", 0, 12)]
    assert len(_spans(df, spans.merge_within_type(F.col("found")))) == 2
    df = _found(spark, [("A", "LOW", 0, 4), ("A", "LOW", 4, 6)])
    assert len(_spans(df, spans.merge(F.col("found")))) == 2
    assert _spans(_found(spark, []), spans.merge(F.col("found"))) == []


def test_decisions(spark):
    rows = [(0, None), (1, ""), (2, "call 13800000000 now"), (3, "call 13800000000, private key 0x" + "0" * 63 + "1"), (4, "see 0x" + "dEaD" * 10), (5, "phone 13800000000 0x" + "dEaD" * 10), (6, "ghp_" + "a" * 36)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in inspection.inspect(df, pepper="p").collect()}
    assert [out[i]["action"] for i in range(7)] == ["ALLOW", "ALLOW", "MASK", "BLOCK", "ALLOW", "MASK", "BLOCK"]
    assert out[0]["sanitized_text"] is None and out[1]["sanitized_text"] == ""
    assert out[2]["sanitized_text"] == "call [PII:PHONE] now"
    assert out[3]["sanitized_text"] == inspection.BLOCKED and len(out[3]["findings"]) == 1
    assert "0xdEaD...dEaD" in out[5]["sanitized_text"]
    events = inspection.audit_events(inspection.inspect(df, pepper="p")).collect()
    assert not any("text" in c for c in events[0].asDict()) and len([e for e in events if e["doc_id"] == 5]) == 2
    alone = {r["doc_id"]: r["action"] for r in inspection.inspect(df, pepper="p", scanners=("secret", "address")).collect()}
    assert alone[2] == "ALLOW" and alone[3] == "BLOCK"


def test_policy(spark):
    matrix = {(r["entity_type"], r["direction"]): r["action"] for r in policy.default_policy(spark).collect()}
    assert len(matrix) == 19 * 11
    assert matrix["API_KEY", "TRACE_PERSIST"] == "MASK" and matrix["ADDRESS", "USER_INPUT"] == "ALLOW" and matrix["EXTENDED_PUBLIC_KEY", "MODEL_OUTPUT"] == "MASK"
    own = spark.createDataFrame([("PII", "USER_INPUT", "REVIEW")], "entity_type string, direction string, action string")
    df = spark.createDataFrame([(0, "a@b.com")], "doc_id long, text string")
    assert inspection.inspect(df, pepper="p", policy=own).first()["action"] == "REVIEW"


def test_fingerprints(spark):
    got = spark.range(1).select(crypto.hmac_sha256(F.lit("abc é"), "k" * 70).alias("h"), crypto.shannon(F.lit("0123456789abcdef")).alias("s"), crypto.shannon(F.lit("")).alias("z")).first()
    assert got["h"] == hmac.new(b"k" * 70, "abc é".encode(), "sha256").hexdigest() and got["s"] == 4.0 and got["z"] == 0.0


def test_conversations(spark):
    key = "0" * 62 + "1f"
    turns = [("c", 0, "私钥 0x" + key[:16]), ("c", 1, key[16:32] + "!"), ("c", 2, "..."), ("c", 3, key[32:]), ("d", 0, key[32:]), ("", 0, "x")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, text string")
    got = {(r["conv_id"], r["turn"]): r["blocked"] for r in conversations.cross_turn(df).collect()}
    assert got == {("c", 0): False, ("c", 1): False, ("c", 3): True, ("d", 0): False}
    two = {(r["conv_id"], r["turn"]): r["window"] for r in conversations.windows(df, n=2).collect()}
    assert two["c", 3] == f"{key[16:32]} {key[32:]}"
    timed = spark.createDataFrame([("c", 0, "one", 0), ("c", 1, "two", 2000), ("c", 2, "three", 2100)], "conv_id string, turn long, text string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["window"] for r in conversations.windows(timed, ts="ts").orderBy("turn").collect()] == ["one", "two", "two three"]


def test_stream(spark, tmp_path):
    held, window = stream.append_turn([("old", 10)], "new", 20, 1, 3)
    assert window == "new" and held == [("new", 1020)]
    spark.createDataFrame([("c", i, t) for i, t in enumerate(["a b", "...", "c!", "d", "e"])], "conv_id string, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id string, turn long, text string").parquet(str(tmp_path / "in"))
    q = stream.windows(source, drop_idle=False).writeStream.format("memory").queryName("turn_windows").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [r["window"] for r in spark.sql("select * from turn_windows order by turn").collect()] == ["a b", "a b c", "a b c d", "c d e"]


def test_stream_audit_failure(spark, tmp_path):
    kept = []
    df = spark.createDataFrame([(0, "a@b.com")], "doc_id long, text string")

    def broken(_):
        raise OSError("no disk")

    stream.inspect_batches(lambda d: kept.extend(d.collect()), broken, pepper="p")(df, 0)
    assert kept[0]["action"] == "MASK"


def test_json_fields():
    f = structured.json_fields
    assert f('{"phone":"138","m":"a b"}') == [("phone", "phone", "138", 10, 13), ("m", "m", "a b", 20, 23)]
    assert [x[0] for x in f('{"w":{"k":"d"},"keys":["a",1,"b"]}')] == ["w.k", "keys[0]", "keys[2]"]
    for bad in ('{"a":"b",}', "[1,]", '{"a"', "   ", "", None, "text", '{"a":1} x'):
        assert f(bad) == [(None, None, bad or "", 0, len(bad or ""))]
    assert f('{"a\\"b":"x\\"y"}') == [('a"b', 'a"b', 'x\\"y', 9, 13)]


def test_providers(spark):
    now = [0.0]
    calls = []

    def slow(*_):
        calls.append(now[0])
        now[0] += 1
        return [1]

    breaker = providers.Breaker(slow, slow=0.5, threshold=2, cooldown=10, clock=lambda: now[0])
    assert [breaker(), breaker(), breaker()] == [[1], [1], []] and len(calls) == 2
    now[0] += 10
    assert breaker() == [1]
    assert providers.parse_analysis([{"entity_type": "EMAIL", "start": 5}, 3]) == [{"type": "EMAIL", "start": 5, "end": -1, "score": 0.0}]
    assert providers.parse_verdict({"scanners": {"Jailbreak": 0.9, "X": 0.1}}, 0.5) == [{"type": "Jailbreak", "start": -1, "end": -1, "score": 0.9}]
    assert providers.post_json("http://127.0.0.1:9/x", {}, 0.2) is None
    df = spark.createDataFrame([("hello world", "en")], "text string, lang string")
    call = providers.entities_udf(lambda: lambda text, lang: [{"type": "PERSON", "start": 0, "end": 5, "score": 0.9}, {"type": "PERSON", "start": 3, "end": 99, "score": 0.9}, {"type": "PERSON", "start": 0, "end": 5, "score": 0.1}])
    rows = df.withColumn("e", call("text", "lang"))
    assert len(rows.select(providers.pii_findings(F.col("text"), F.col("e"))).first()[0]) == 1
    assert [(f["start"], f["end"]) for f in rows.select(providers.injection_findings(F.col("text"), F.col("e"))).first()[0]] == [(0, 5), (3, 11)]


def test_json_columns(spark):
    """Fields as columns are those of the reader in Python, on JSON made and broken by chance; long ones too."""
    import random

    rng = random.Random(2)

    def value(depth=0):
        space = lambda: rng.choice(["", " ", "\n"])
        string = lambda: '"' + "".join(rng.choice(["a", "b_c", "é", '\\"', "\\n", " ", ":", "{", "]", "\\\\"]) for _ in range(rng.randint(0, 4))) + '"'
        kind = rng.random()
        if depth > 3 or kind < 0.3:
            return string()
        if kind < 0.45:
            return rng.choice(["1", "true", "null", "x-y"])
        if kind < 0.75:
            return "{" + space() + ("," + space()).join(string() + space() + ":" + space() + value(depth + 1) for _ in range(rng.randint(0, 3))) + space() + "}"
        return "[" + space() + (space() + ",").join(value(depth + 1) for _ in range(rng.randint(0, 3))) + space() + "]"

    texts = ['{"a":"b",}', "[1,]", '{"a"', "   ", "", '{"a":1} x', "[1 2]", '{"a":"x" "y"}', '{"a":"b"}"c":"d"', "[" * 300 + '"deep"' + "]" * 300, "[" + ",".join(f'{{"k{i}":"v{i}"}}' for i in range(3000)) + "]"]
    for _ in range(600):
        t = value()
        if rng.random() < 0.4 and t:
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", '"', ",", "}", "x", " "]) + t[i + rng.randint(0, 1) :]
        texts.append(rng.choice(["", " "]) + t)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", structured.fields_in(F.col("t")).alias("f")).collect():
        want = structured.json_fields(r["t"])
        plain = want == [(None, None, r["t"], 0, len(r["t"]))]
        assert [tuple(x) for x in r["f"]] == ([] if plain else [x[1:] for x in want]), r["t"]


def test_inspection_of_json(spark):
    key = "ab" * 32
    rows = [(1, f'{{"private_key":"{key}"}}'), (2, f'{{"a":{{"wallet-key": "0x{key}"}},"b":["x"]}}'), (3, f'{{"private_key":"{key}",}}'), (4, '{"m":"mail a@b.com"}'), (5, f'["{key}"]'), (6, '{"password":"","b":"long value that is no password"}')]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["action"], [(f["risk_level"], f["start"], f["end"]) for f in r["findings"]]) for r in inspection.inspect(df, pepper="p").collect()}
    assert got[1] == ("BLOCK", [("CRITICAL", 16, 80)]) and got[2] == ("BLOCK", [("CRITICAL", 21, 87)]) and got[3] == ("BLOCK", [("MEDIUM", 16, 80)])
    assert got[4] == ("MASK", [("MEDIUM", 11, 18)]) and got[5] == ("BLOCK", [("MEDIUM", 2, 66)])
    plain = {r["doc_id"]: [f["risk_level"] for f in r["secrets"]] for r in inspection.detect(df, fields=False).collect()}
    assert plain[1] == ["MEDIUM"]
