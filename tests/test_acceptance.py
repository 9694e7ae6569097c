"""Acceptance cases from files, with placeholders and turns; providers asked by many threads."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from veilstream.functions import codecs
from veilstream.plans import acceptance
from veilstream.sources import providers
from veilstream.sources.wordlists import syllable_wordlist

KEY = "0" * 62 + "1f"


def _case(name, **more):
    return {"id": name, "category": "own", "direction": "USER_INPUT", "sampleSource": "test"} | more


def test_cases(spark, tmp_path):
    turns = [{"text": "private key 0x" + KEY[:20]}, {"text": KEY[20:40]}, {"text": KEY[40:]}]
    first = [
        _case("wif", input="key <<WIF_COMPRESSED>> .", expectedAction="BLOCK", expectedEntityTypes=["PRIVATE_KEY_WIF"], mustNotResidual=["<<WIF_COMPRESSED>>"]),
        _case("others", input="<<XPRV>> <<SUI_PRIVKEY>> <<STELLAR_SEED>> solana keypair <<SOLANA_KEYPAIR>>", expectedAction="BLOCK", expectedEntityTypes=["EXTENDED_PRIVATE_KEY", "SUI_PRIVKEY", "STELLAR_SECRET_SEED", "SOLANA_KEYPAIR"]),
        _case("plain", input="nothing", expectedAction="ALLOW", expectedEntityTypes=[], mayAllowFlowThrough=True),
        _case("mask", input="mail a@b.com", expectedAction="MASK", expectedEntityTypes=["PII"], expectedMaskFormat="\\[PII:EMAIL\\]", mustNotResidual=["a@b.com"], subCategory="boundary-exact"),
        _case("gap", input="nothing", expectedAction="BLOCK", expectedEntityTypes=["JWT"], knownGap="no such rule"),
        _case("wrong", input="mail a@b.com", expectedAction="MASK", expectedEntityTypes=[], expectedMinFindings=2, mustNotResidual=["mail"]),
        _case("later", input="x", expectedAction="deferred-1"),
        _case("", input="x", expectedAction="ALLOW"),
        _case("nothing to judge", expectedAction="ALLOW"),
    ]
    second = [
        _case("split", turns=turns, expectedAction="BLOCK", expectedEntityTypes=["PRIVATE_KEY_HEX"], conversationId="c"),
        _case("too early", turns=turns, assertTurnIndex=1, expectedAction="ALLOW", expectedEntityTypes=[]),
        _case("beyond", turns=turns, assertTurnIndex=9, expectedAction="ALLOW"),
        _case("split", turns=turns[:2], expectedAction="BLOCK", expectedEntityTypes=["PRIVATE_KEY_HEX"]),
    ]
    for name, cases in (("a", first), ("b", second), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"cases": cases}, indent=1))
    results = acceptance.run_cases(acceptance.read_cases(spark, str(tmp_path)), syllable_wordlist(spark), "p")
    got = sorted((r["bucket"], r["fails"]) for r in results.collect())
    assert got == sorted([("PASS", [])] * 6 + [("KNOWN_GAP_FAIL", ["action", "entityTypes"]), ("REGRESSION_FAIL", ["entityTypes", "minFindings", "residual"]), ("SKIPPED", [])] + [("REGRESSION_FAIL", ["schema"])] * 2 + [("REGRESSION_FAIL", ["assertTurnIndex"]), ("REGRESSION_FAIL", ["action", "entityTypes"])])
    assert acceptance.report(results).collect() == [("own", 6, 1, 5, 1)]
    assert [tuple(r) for r in acceptance.known_gaps(results).collect()] == [("no such rule", "KNOWN_GAP_FAIL", 1)]


def test_placeholders_hold():
    made = acceptance.placeholders()
    assert codecs.is_wif(made["<<WIF_MAINNET>>"]) and codecs.is_sui_key(made["<<SUI_PRIVKEY>>"]) and codecs.is_stellar_seed(made["<<STELLAR_SEED>>"])
    assert [codecs.extended_key(made[f"<<{k}>>"]) for k in ("XPRV", "XPUB", "TPRV", "YPRV")] == ["private", "public", "private", "private"]


@pytest.fixture
def service():
    """A stub that takes a tenth of a second for an answer, and counts them."""
    asked, lock = [], threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                asked.append((body["text"], body["language"]))
            time.sleep(0.1)
            data = json.dumps(None if body["text"] == "none" else [{"entity_type": "PERSON", "start": 0, "end": 4, "score": 0.9}]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    class Server(ThreadingHTTPServer):
        request_queue_size = 128

    server = Server(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", asked
    server.shutdown()


def test_many_requests_at_a_time(spark, service):
    url, asked = service
    rows = [(i, f"Anna {i % 150}") for i in range(300)] + [(300, None), (301, ""), (302, "none"), (303, "你好 Anna")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("entities_of", F.lit("clash")).coalesce(1)
    began = time.time()
    out = providers.ask_all(df, lambda: providers.pii_client(url, 5.0), requests=32, slow=60.0)
    got = {r["doc_id"]: r["entities"] for r in out.collect()}
    assert time.time() - began < 12  # one after the other would take over 15 s
    assert len(asked) == 152 and ("你好 Anna", "zh") in asked
    assert got[300] == got[301] == got[302] == [] and all(len(got[i]) == 1 for i in range(300)) and got[7][0]["type"] == "PERSON"
    found = out.select(providers.pii_findings(F.col("text"), F.col("entities")).alias("f")).where("size(f) = 1")
    assert found.count() == 301


def test_threads_share_a_breaker(spark, service):
    url, asked = service
    df = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string").coalesce(1)
    out = providers.ask_all(df, lambda: providers.pii_client(url, 5.0), requests=4, slow=0.01, threshold=3, cooldown=600.0)
    answered = out.where("size(entities) > 0").count()
    assert 3 <= answered <= 3 + 4 and len(asked) == answered  # after three slow calls only those already on their way


def test_breaker_counts_slow_calls_in_a_row():
    now = [0.0]

    def call(seconds):
        now[0] += seconds
        return [seconds]

    b = providers.Breaker(call, slow=1.0, threshold=2, cooldown=5.0, clock=lambda: now[0])
    assert [b(2), b(0), b(2), b(2), b(0)] == [[2], [0], [2], [2], []] and b.trips == 1
