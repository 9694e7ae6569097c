"""Acceptance cases: read, filled in, run through the inspection, put into buckets, counted.

Cases lie in JSON files {"cases": [...]}. A case has one input, or turns of a conversation of which one is judged. Each
assertion is a column that holds a failure or null; a case passes if all are null. A case that fails is a known gap if it
says so, else a regression; one whose expected action is deferred is skipped. Nothing fails a job: the report is data.

Defined results: a case without id, category, direction or sample source fails, as does one whose turn to judge isn't
there. Cases that share an id are told apart by their place, and a file without cases gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.crypto import pepper as own_pepper
from ..operators import conversations
from . import inspection
from .configured import found_types, holds

CASE = """id string, category string, subCategory string, direction string, sampleSource string, notes string, expectedAction string,
expectedEntityTypes array<string>, expectedMinFindings int, mustNotResidual array<string>, mayAllowFlowThrough boolean, expectedMaskFormat string,
knownGap string, input string, turns array<struct<text:string>>, conversationId string, assertTurnIndex int"""
BUCKETS = ["PASS", "KNOWN_GAP_FAIL", "REGRESSION_FAIL", "SKIPPED"]
REQUIRED = ("id", "category", "direction", "sampleSource", "expectedAction")


def placeholders() -> dict[str, str]:
    """Placeholders and the keys they stand for: encoded here, with payloads of zeros, so that no key is stored anywhere."""
    extended = lambda version: codecs.base58check_encode(bytes.fromhex(version) + bytes(74))
    return {
        "<<WIF_MAINNET>>": codecs.base58check_encode(b"\x80" + bytes(32)), "<<WIF_COMPRESSED>>": codecs.base58check_encode(b"\x80" + bytes(32) + b"\x01"),
        "<<XPRV>>": extended("0488ADE4"), "<<XPUB>>": extended("0488B21E"), "<<TPRV>>": extended("04358394"), "<<YPRV>>": extended("049D7878"),
        "<<SUI_PRIVKEY>>": codecs.bech32_encode("suiprivkey", codecs.convert_bits(bytes(33), 8, 5, True)), "<<STELLAR_SEED>>": codecs.stellar_seed(bytes(32)), "<<SOLANA_KEYPAIR>>": "[" + ",".join(["0"] * 64) + "]",
    }


def filled(text: Column) -> Column:
    for name, value in placeholders().items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return text


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The cases of all files below a path, with `place`, which tells them apart. lines: an object a line, not a file."""
    files = spark.read.schema(f"cases array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields())}>>").option("multiLine", not lines).json(path)
    return files.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"), F.posexplode("cases").alias("_at", "case")).select(F.concat_ws(":", "_file", "_row", "_at").alias("place"), "case.*")


def _fields() -> list[str]:
    """The fields of CASE; commas inside a type don't part them."""
    out, depth, last = [], 0, ""
    for c in CASE:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(last)
            last = ""
        else:
            last += c
    return [*out, last]


def _fails(failed: Column, what: str) -> Column:
    return F.when(F.coalesce(failed, F.lit(False)), F.lit(what))


def _types(found: Column) -> Column:
    """Failures of the expected types: none expected means that none may be found."""
    return _fails(~holds(found, F.coalesce("expectedEntityTypes", F.array().cast("array<string>"))), "entityTypes")


def _single(cases: DataFrame, key: str, wordlist: DataFrame | None, **options) -> DataFrame:
    rows = cases.withColumn("_text", filled(F.col("input")))
    out = inspection.inspect(rows, id_col="place", text="_text", direction=F.col("direction"), pepper=key, wordlist=wordlist, **options)
    said, masked = F.col("sanitized_text"), F.col("action") == "MASK"
    prints = F.transform(F.regexp_extract_all(said, F.lit("\\[(?:BLOCKCHAIN_SECRET|SECRET):[A-Z_]+:([0-9a-f]{8})\\]"), F.lit(1)), lambda p: F.contains(F.col("_text"), p))
    kind = F.col("subCategory")
    return out.withColumn("fails", F.array_compact(F.array(
        _fails(F.col("action") != F.col("expectedAction"), "action"),
        _types(found_types(F.col("findings"))),
        _fails(F.size("findings") < F.coalesce("expectedMinFindings", F.lit(0)), "minFindings"),
        _fails(F.exists(F.filter(F.coalesce("mustNotResidual", F.array().cast("array<string>")), lambda r: F.length(r) > 0), lambda r: F.contains(said, filled(r))), "residual"),
        _fails(F.col("mayAllowFlowThrough") & (said != F.col("_text")), "flowThrough"),
        _fails((kind == "boundary-exact") & F.exists("findings", lambda f: (f["start"] < 0) | (f["end"] > F.length("_text")) | (f["start"] >= f["end"])), "span"),
        _fails(masked & ~F.rlike(said, F.col("expectedMaskFormat")), "maskFormat"),
        _fails((kind == "fingerprint-not-raw") & masked & F.exists(prints, lambda p: p), "fingerprint"),
        _fails((kind == "json-key-secret") & masked & F.contains("_text", F.lit('"mnemonic"')) & ~F.contains(said, F.lit('"mnemonic"')), "structure"),
    ))).select("place", "category", "knownGap", "expectedAction", "action", found_types(F.col("findings")).alias("types"), "fails")


def _several(cases: DataFrame, wordlist: DataFrame | None) -> DataFrame:
    turns = cases.select("place", F.posexplode("turns").alias("turn", "t")).select("place", F.col("turn").cast("long").alias("turn"), filled(F.col("t.text")).alias("text"))
    judged = conversations.cross_turn(turns, conv="place", wordlist=wordlist).select(F.col("place").alias("_p"), F.col("turn").alias("_t"), "blocked", "critical_entities")
    rows = cases.withColumn("_at", F.coalesce("assertTurnIndex", F.size("turns") - 1).cast("long"))
    rows = rows.join(judged, (F.col("place") == F.col("_p")) & (F.col("_at") == F.col("_t")), "left")
    blocked, types = F.coalesce("blocked", F.lit(False)), F.coalesce("critical_entities", F.array().cast("array<string>"))
    there = (F.col("_at") >= 0) & (F.col("_at") < F.size("turns"))
    fails = F.array_compact(F.array(_fails(~there, "assertTurnIndex"), _fails(there & (blocked != (F.col("expectedAction") == "BLOCK")), "action"), F.when(there, _types(types))))
    return rows.select("place", "category", "knownGap", "expectedAction", F.when(blocked, "BLOCK").otherwise("ALLOW").alias("action"), types.alias("types"), fails.alias("fails"))


def run_cases(cases: DataFrame, wordlist: DataFrame | None = None, pepper: str | None = None, **options) -> DataFrame:
    """(place, category, action, types, fails, bucket) of every case. options: of `inspection.inspect`."""
    key = pepper or own_pepper()
    deferred = F.coalesce(F.startswith("expectedAction", F.lit("deferred-")), F.lit(False))
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & (F.length(F.coalesce(name, F.lit(""))) > 0)
    whole = whole & (F.col("input").isNotNull() | (F.size(F.coalesce("turns", F.array().cast("array<struct<text:string>>"))) > 0))
    many = F.size(F.coalesce("turns", F.array().cast("array<struct<text:string>>"))) > 0
    told = lambda where, fails: cases.where(where).select("place", "category", "knownGap", "expectedAction", F.lit(None).cast("string").alias("action"), F.array().cast("array<string>").alias("types"), fails.cast("array<string>").alias("fails"))
    out = _single(cases.where(~deferred & whole & ~many), key, wordlist, **options).unionByName(_several(cases.where(~deferred & whole & many), wordlist))
    out = out.unionByName(told(deferred, F.array())).unionByName(told(~deferred & ~whole, F.array(F.lit("schema"))))
    skipped = F.coalesce(F.startswith("expectedAction", F.lit("deferred-")), F.lit(False))
    bucket = F.when(skipped, "SKIPPED").when(F.size("fails") == 0, "PASS").when(F.col("knownGap").isNotNull(), "KNOWN_GAP_FAIL").otherwise("REGRESSION_FAIL")
    return out.withColumn("bucket", bucket).drop("expectedAction")


def report(results: DataFrame) -> DataFrame:
    """Cases by category and bucket."""
    return results.groupBy("category").pivot("bucket", BUCKETS).count().na.fill(0, BUCKETS)


def known_gaps(results: DataFrame) -> DataFrame:
    """(knownGap, bucket, cases): what is known to fail, and whether it still does."""
    return results.where("knownGap is not null").groupBy("knownGap", "bucket").agg(F.count(F.lit(1)).alias("cases"))
