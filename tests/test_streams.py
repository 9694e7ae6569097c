"""Keyed state of conversations, event time, the audit log, mnemonics inside rows, and spans of large texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilstream.functions import spans
from veilstream.operators import mnemonics
from veilstream.plans import inspection, queries
from veilstream.sources.audit import AuditLog
from veilstream.sources.wordlists import syllable_wordlist
from veilstream.streaming import conversations as stream


def _phrase(spark, count=12, other=False):
    """List words with a valid checksum, found by trying last words; other: with one that doesn't hold."""
    words = [r["word"] for r in syllable_wordlist(spark).orderBy("idx").collect()]
    body = [(k * 577 + 3) % 2048 for k in range(count - 1)]
    df = spark.range(2048).select(F.col("id").alias("last"), mnemonics.checksum_holds(F.array(*map(F.lit, body), F.col("id"))).alias("ok"))
    last = df.where("ok" if not other else "not ok").orderBy("last").first()["last"]
    return " ".join(words[k] for k in (*body, last))


@pytest.mark.parametrize("delay", [None, 0, 30])
def test_turns_by_brute_force(delay):
    rng = random.Random(delay)
    for _ in range(60):
        n, ttl = rng.choice([1, 2, 3, 5]), rng.choice([5, 40, 10**6])
        came, held, newest, late = [], [], None, 0
        state = stream.Turns([], 0, None, n, ttl, delay)
        for k in range(200):
            at = k * 10 + rng.choice([0, 0, 0, -20, -45, -10])
            window = state.add(str(k), at)
            if delay is not None and newest is not None and at < newest - delay:
                assert window is None
                late += 1
                continue
            newest = at if newest is None else max(newest, at)
            came.append((at, k))
            seen = sorted(t for t in came if t <= (at, k))[-n:]
            if delay is not None:  # without a delay old turns may be gone
                assert window == " ".join(str(i) for when, i in seen if when > at - ttl)
            if rng.random() < 0.3:  # a new batch: the state goes to the store and comes back
                new, old = state.changes()
                held = [t for t in held if t[1] not in old] + new
                assert sorted(held) == state.held and len(held) <= 64
                rng.shuffle(held)
                state = stream.Turns(held, state.number, state.newest, n, ttl, delay)


def _run(rows, at, name):
    query = rows.writeStream.format("memory").queryName(name).option("checkpointLocation", str(at)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return rows.sparkSession.sql(f"select * from {name}").collect()


def test_stream_orders_across_arrow_batches(spark, tmp_path):
    """A hundred turns of one conversation in two rounds, read in Arrow batches of seven; the second round finds the first's state."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        kind, out = "conv_id string, turn long, text string", {}
        for k, part in enumerate((range(60), range(60, 100))):
            rows = [("c", i, f"t{i}") for i in part]
            random.Random(1).shuffle(rows)
            spark.createDataFrame([*rows, (None, 0, "x"), (" ", 0, "x"), ("d", k, "...")], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
            found = stream.run_available(stream.windows(source, n=3, drop_idle=False), f"file://{tmp_path}/out").collect()
            out = {(r["conv_id"], r["turn"]): r["window"] for r in found}
            assert len(out) == len(found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert out == {("c", i): " ".join(f"t{j}" for j in range(max(0, i - 2), i + 1)) for i in range(100)}


def test_stream_finds_split_mnemonics(spark, tmp_path):
    words = _phrase(spark).split()
    rows = [("c", 0, " ".join(words[:5])), ("c", 1, " ".join(words[5:9]) + "!"), ("c", 2, " ".join(words[9:])), ("d", 0, "nothing here")]
    spark.createDataFrame(rows, "conv_id string, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conv_id string, turn long, text string").parquet(str(tmp_path / "in"))
    found = _run(stream.cross_turn(source, syllable_wordlist(spark), drop_idle=False), tmp_path / "check", "split_phrase")
    assert [(r["conv_id"], r["turn"], r["types"]) for r in found] == [("c", 2, ["MNEMONIC"])]


def test_audit_log_after_a_restart(spark, tmp_path):
    """A batch fails after its events are written; the stream, started again from its checkpoint, leaves each event once."""
    log, tries = AuditLog(f"file://{tmp_path}/log", "mail"), []
    for k in range(2):
        spark.createDataFrame([(k, f"a{k}@b.com or 13800000000")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))

    def once(batch, number):
        stream.inspect_batches(lambda _: None, log, pepper="p")(batch, number)
        tries.append(number)
        if len(tries) == 1:
            raise RuntimeError("lost after the write")

    def start():
        source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return source.writeStream.foreachBatch(once).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="lost after the write"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert tries[:2] == [0, 0]
    events = log.read(spark)
    assert sorted((r["doc_id"], r["rule_id"]) for r in events.collect()) == [(k, rule) for k in (0, 1) for rule in ("pii-cn-phone", "pii-email")]
    assert "text" not in events.columns
    # days fall away as a whole
    log.write(events.drop("day", "stream", "batch").limit(1), 9, F.lit("2020-01-31").cast("date"))
    assert log.retain(spark) == 1 and log.read(spark).count() == 4 and log.drop_before(spark, "2000-01-01") == 0


def test_a_log_without_a_batch_is_no_result(spark, tmp_path, monkeypatch):
    """A batch whose events can't be written fails, after its decisions, unless the failure is asked for."""
    write = AuditLog.write

    def full(self, events, batch, day=None):
        if batch == 1:
            raise OSError("no space left")
        write(self, events, batch, day)

    monkeypatch.setattr(AuditLog, "write", full)
    spark.sql("select id as c_custkey, concat('Customer#', id) as c_name from range(9)").write.parquet(f"{tmp_path}/customer.parquet")
    with pytest.raises(OSError, match="no space left"):
        queries.QUERIES["audit_log"](spark, str(tmp_path))
    df, log = spark.createDataFrame([(0, "a@b.com")], "doc_id long, text string"), AuditLog(f"file://{tmp_path}/log")
    kept, failed = [], []
    with pytest.raises(OSError, match="no space left"):
        stream.inspect_batches(lambda d: kept.extend(d.collect()), log, pepper="p")(df, 1)
    assert [r["action"] for r in kept] == ["MASK"]
    told = stream.inspect_batches(lambda _: None, log, audit_failed=lambda e, number: failed.append((str(e), number)), pepper="p")
    told(df, 1)
    told(df, 2)
    assert failed == [("no space left", 1)] and [r["batch"] for r in log.read(spark).collect()] == [2]


def test_mnemonics_need_no_id(spark):
    phrase, odd = _phrase(spark), _phrase(spark, other=True)
    rows = [(None, f"a@b.com {phrase}"), (1, f"{phrase} a@b.com"), (1, f"one {phrase.upper()}"), (2, phrase), (3, odd), (3, f"mnemonic: {odd}"), (4, phrase.replace(" ", "\n　")), (5, phrase.replace(" ", ", ")), (None, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = inspection.inspect(df, pepper="p", wordlist=syllable_wordlist(spark))
    got = {r["text"]: (r["action"], r["sanitized_text"]) for r in out.collect()}
    assert [got[t][0] for _, t in rows] == ["BLOCK"] * 4 + ["ALLOW", "BLOCK", "BLOCK", "ALLOW", "ALLOW", "ALLOW"]
    assert not any(phrase in (s or "") for _, s in got.values() if _ == "BLOCK")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    long = spark.createDataFrame([(1, "zzzz " * 3 + (phrase + " ") * 300)], "doc_id long, text string")
    assert mnemonics.mnemonics(long, syllable_wordlist(spark)).where("checksum").agg(F.countDistinct("start")).first()[0] >= 300


def test_word_tables(spark):
    listed = syllable_wordlist(spark)
    table = mnemonics.word_table(listed, "english")
    out = listed.select("word", "idx", table.holds(F.col("word")).alias("has"), table.number(F.col("word")).alias("n"), table.holds(F.concat("word", F.lit("x"))).alias("other"))
    assert out.where("not has or n != idx or other").count() == 0
    with pytest.raises(ValueError, match="at most"):
        mnemonics.word_table(listed.unionByName(listed.limit(1).withColumn("word", F.lit("more"))), "english")


def test_many_findings_in_one_text(spark):
    """100,000 addresses in one text, and their masks."""
    text = "".join(f"m{i}@b.com é日 " for i in range(100_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    df.count()
    began = time.time()
    r = inspection.inspect(df, pepper="p", scanners=("pii",)).select("sanitized_text", F.size("findings").alias("n")).first()
    assert r["n"] == 100_000 and r["sanitized_text"] == "[PII:EMAIL] é日 " * 100_000
    assert time.time() - began < 120


def test_overlapping_masks_by_brute_force(spark):
    rng = random.Random(4)
    risks = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    rows = []
    for k in range(40):
        text = "".join(rng.choice("ab é日😀\n") for _ in range(rng.choice([0, 9, 40, 3000])))
        found = [(rng.choice(["PII", "API_KEY"]), rng.choice(risks), 0.5, s := rng.randrange(-3, len(text) + 5), s + rng.randrange(0, 9), "pii-email", "") for _ in range(rng.choice([0, 1, 5, 700]))]
        rows.append((k, text, found))
    got = {r["k"]: r["out"] for r in spark.createDataFrame(rows, f"k long, text string, found {spans.FINDINGS}").select("k", spans.replace_spans(F.col("text"), spans.merge(F.col("found")), lambda x, raw: F.concat(F.lit("["), x["entity_type"], F.lit(":"), raw, F.lit("]"))).alias("out")).collect()}
    for k, text, found in rows:
        merged = []
        for i, f in sorted(enumerate(found), key=lambda x: (x[1][3], -x[1][4], x[0])):
            if merged and f[3] < merged[-1][2]:
                last = merged[-1]
                wins = risks.index(f[1]) > risks.index(last[3])
                merged[-1] = (f[0] if wins else last[0], last[1], max(last[2], f[4]), f[1] if wins else last[3])
            else:
                merged.append((f[0], f[3], f[4], f[1]))
        out, at = "", 0
        for entity, s, e, _ in merged:
            s, e = max(s, 0), min(e, len(text))
            if e > s:
                out += f"{text[at:s]}[{entity}:{text[s:e]}]"
                at = e
        assert got[k] == out + text[at:]
