"""Findings from remote services: requests, answers, a circuit breaker, and scanners over what came back.

A call runs in a Python worker, one client each, and never fails a job: a slow or broken service gives no entities.
"""

from __future__ import annotations

import json
import threading
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import FINDINGS, finding

ENTITIES = "array<struct<type:string,start:int,end:int,score:double>>"
#: Types of high risk, and those that are let through by default.
HIGH_TYPES = ["CREDIT_CARD", "US_SSN", "IBAN_CODE", "CN_USCC", "CN_PASSPORT", "US_PASSPORT", "MEDICAL_LICENSE"]
ALLOWED_TYPES = ["PERSON", "LOCATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "IP_ADDRESS", "US_SSN", "CRYPTO", "MEDICAL_LICENSE", "US_PASSPORT", "CN_USCC", "CN_LICENSE_PLATE", "CN_PASSPORT"]
MIN_SCORE = 0.5


def language(text: Column, configured: str = "auto") -> Column:
    """zh for a text with a Chinese character, else en; a configured language is kept."""
    if configured.lower() != "auto":
        return F.lit(configured)
    return F.when(F.rlike(F.coalesce(text, F.lit("")), F.lit("[\\u4E00-\\u9FFF]")), "zh").otherwise("en")


class Breaker:
    """After `threshold` slow calls in a row no call is made for `cooldown` seconds; then the count starts anew."""

    def __init__(self, call: Callable, slow: float = 0.3, threshold: int = 3, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.call, self.slow, self.threshold, self.cooldown, self.clock = call, slow, threshold, cooldown, clock
        self.in_a_row, self.closed_until = 0, float("-inf")
        self.trips, self.lock = 0, threading.Lock()

    def __call__(self, *args) -> list:
        """Threads share a breaker: the count is theirs together, and no lock is held during a call."""
        began = self.clock()
        with self.lock:
            if began < self.closed_until:
                return []
        found = self.call(*args)
        ended = self.clock()
        with self.lock:
            self.in_a_row = self.in_a_row + 1 if ended - began >= self.slow else 0
            if self.in_a_row >= self.threshold:
                self.closed_until, self.in_a_row, self.trips = ended + self.cooldown, 0, self.trips + 1
        return found


def post_json(url: str, body: dict, timeout: float):
    """The answer, or None on any failure."""
    try:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (OSError, ValueError):
        return None


def parse_analysis(answer) -> list[dict]:
    """Entities of an analysis: a list of {entity_type, start, end, score}; what is missing gets '', -1, -1, 0."""
    rows = answer if isinstance(answer, list) else []
    return [{"type": str(x.get("entity_type", "")), "start": int(x.get("start", -1)), "end": int(x.get("end", -1)), "score": float(x.get("score", 0.0))} for x in rows if isinstance(x, dict)]


def parse_verdict(answer, threshold: float = 0.0) -> list[dict]:
    """Entities of a verdict {scanners: {name: score}}: those at or above the threshold, without a span."""
    scores = answer.get("scanners") if isinstance(answer, dict) else None
    return [{"type": k, "start": -1, "end": -1, "score": float(v)} for k, v in (scores or {}).items() if isinstance(v, int | float) and v >= threshold]


def verdicts(answer: Column) -> Column:
    """Answers kept as JSON texts: (valid, scanners, sanitized). What can't be read is valid, without scores and text."""
    read = F.from_json(answer, "is_valid boolean, scanners map<string,double>, sanitized_prompt string")
    return F.struct(F.coalesce(read["is_valid"], F.lit(True)).alias("valid"), F.coalesce(read["scanners"], F.create_map().cast("map<string,double>")).alias("scanners"), read["sanitized_prompt"].alias("sanitized"))


def pii_client(endpoint: str, timeout: float = 0.3) -> Callable[[str, str], list]:
    return lambda text, lang: parse_analysis(post_json(endpoint.removesuffix("/") + "/analyze", {"text": text, "language": lang}, timeout))


def injection_client(endpoint: str, timeout: float = 0.5, threshold: float = 0.0) -> Callable[[str, str], list]:
    return lambda text, lang: parse_verdict(post_json(endpoint.removesuffix("/") + "/analyze/prompt", {"prompt": text}, timeout), threshold)


def entities_udf(make_client: Callable[[], Callable[[str, str], list]], slow: float = 0.3, threshold: int = 3, cooldown: float = 30.0):
    """A pandas UDF (text, language) -> entities; each batch keeps its worker's client and breaker (none for threshold 0)."""
    held: dict = {}

    @F.pandas_udf(ENTITIES)
    def call(text: pd.Series, lang: pd.Series) -> pd.Series:
        if "client" not in held:
            held["client"] = Breaker(make_client(), slow, threshold, cooldown) if threshold else make_client()
        return pd.Series([held["client"](t, g) if t else [] for t, g in zip(text, lang, strict=True)])

    return call


def ask_all(df: DataFrame, make_client: Callable[[], Callable[[str, str], list]], text: str = "text", lang: Column | None = None, to: str = "entities", requests: int = 16, slow: float = 0.3, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """df with the entities of each text, from a service that each task asks `requests` questions at a time.

    A task asks equal texts of a batch once, and its requests share one breaker (none for threshold 0). A null or empty
    text isn't asked and has no entities; an answer of None counts as none. Rows stay in their order and their tasks.
    """
    given = "_lang_asked"
    rows, names = df.withColumn(given, language(F.col(text)) if lang is None else lang), [*df.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Breaker(make_client(), slow, threshold, cooldown) if threshold else make_client()
        kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        with ThreadPoolExecutor(requests) as pool:
            for batch in batches:
                asked = list(zip(batch.column(text).to_pylist(), batch.column(given).to_pylist(), strict=True))
                once = list(dict.fromkeys(q for q in asked if q[0]))
                found = dict(zip(once, pool.map(lambda q: client(*q) or [], once), strict=True))
                kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != given]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([found.get(q, []) for q in asked], kind)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, `{to}` {ENTITIES}")


def pii_findings(text: Column, entities: Column, min_score: float = MIN_SCORE, allowed: list[str] | None = None) -> Column:
    """Entities of sufficient score and an allowed type (an empty list allows all), with a span inside the text."""
    allowed = ALLOWED_TYPES if allowed is None else allowed
    good = F.filter(entities, lambda e: (e["score"] >= min_score) & (e["type"].isin(allowed) if allowed else F.lit(True)) & (e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.length(text)))
    one = lambda e: finding(e, "PII", F.when(e["type"].isin(HIGH_TYPES), "HIGH").otherwise("MEDIUM"), e["score"], "", "provider").withField("rule_id", F.concat(F.lit("pii-presidio:"), e["type"]))
    return F.transform(good, one).cast(FINDINGS)


def injection_findings(text: Column, entities: Column, min_score: float = MIN_SCORE) -> Column:
    """Entities of sufficient score; one without a span covers the whole text."""
    good = F.filter(entities, lambda e: e["score"] >= min_score)

    def one(e: Column) -> Column:
        start = F.greatest(e["start"], F.lit(0))
        end = F.least(F.when(e["end"] <= start, F.length(text)).otherwise(e["end"]), F.length(text))
        return finding(F.struct(start.alias("start"), end.alias("end")), "PROMPT_INJECTION", "HIGH", e["score"], "", "provider").withField("rule_id", F.concat(F.lit("injection-llmguard:"), e["type"]))

    return F.transform(good, one).cast(FINDINGS)


def threshold_scanners(scores: Column, threshold: float) -> Column:
    """map<name, score> to entities without a span, those at or above the threshold."""
    kept = F.map_entries(F.map_filter(scores, lambda k, v: v.isNotNull() & (v >= threshold)))
    return F.transform(kept, lambda e: F.struct(e["key"].alias("type"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), e["value"].alias("score")))
