"""Stateful streams: the last turns of each conversation, scanned as they arrive; and inspection of a stream of texts.

A conversation's state is a map of its turns, each with its time, and one value with the next number and the newest
time. A batch reads the map once and writes only what changes: new turns, and those that leave it.

Time is that of processing, or of a time column. With a time column turns may come out of order: a turn's window holds
what has come so far and isn't newer than it, within `ttl` of its time. A turn more than `delay` older than the newest
one that came before it is late: it is reported, without a window, and isn't held. Which turns are late depends on the
order in which they come only, not on how the stream is cut into batches.

Defined results: turns without letters or digits give no row and take no slot, nor do those of a null or blank
conversation. Turns that come in one batch are taken by `order`, equal ones by their text, also across Arrow batches. A
turn without a time has that of the newest before it, the first one that of processing. The state needs the RocksDB
store, which `windows` chooses for the session.
"""

from __future__ import annotations

import bisect
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.conversations import MOST_TURNS, TTL_SECONDS, TURNS
from ..sources.audit import AuditLog

_NOT_WORDS = re.compile(r"[\W_]+")
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalise(text: str | None) -> str:
    return _NOT_WORDS.sub(" ", text or "").strip()


def append_turn(held: list[tuple[str, int]], text: str, now: int, ttl: int, n: int) -> tuple[list[tuple[str, int]], str]:
    """(turns to keep, window): drops what has expired, adds the turn, and joins the last n."""
    live = [(t, end) for t, end in held if end > now]
    live = [*live, (text, now + ttl * 1000)][-MOST_TURNS:]
    return live, " ".join(t for t, _ in live[-n:])


class Turns:
    """The turns held of one conversation, as (time, number, text) in order of time."""

    def __init__(self, held: list[tuple[int, int, str]], number: int, newest: int | None, n: int, ttl: int, delay: int | None):
        self.held, self.number, self.newest = sorted(held), number, newest
        self.n, self.ttl, self.delay = n, ttl, delay
        self.stored = {seq for _, seq, _ in held}

    def add(self, text: str, at: int) -> str | None:
        """The turn's window, or None if it is late."""
        if self.delay is not None and self.newest is not None and at < self.newest - self.delay:
            return None
        self.newest = at if self.newest is None else max(self.newest, at)
        turn = (at, self.number, text)
        self.number += 1
        bisect.insort(self.held, turn)
        upto = self.held[: bisect.bisect_right(self.held, turn)][-self.n :]
        window = " ".join(t for when, _, t in upto if when > at - self.ttl)
        # no turn that isn't late reaches back further than this
        gone = self.newest - self.ttl - (self.delay or 0)
        self.held = [t for t in self.held if t[0] > gone][-MOST_TURNS:]
        return window

    def changes(self) -> tuple[list[tuple[int, int, str]], set[int]]:
        """(turns to write, numbers to remove)."""
        kept = {seq for _, seq, _ in self.held}
        return [t for t in self.held if t[1] not in self.stored], self.stored - kept


class WindowProcessor(StatefulProcessor):
    def __init__(self, n: int, ttl: int, delay: int | None, timed: bool, now: Callable[[], int], drop_idle: bool):
        self.n, self.ttl, self.delay, self.timed, self.now, self.drop_idle = n, ttl * 1000, None if delay is None else delay * 1000, timed, now, drop_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "number long", "at long, text string")
        self.about = handle.getValueState("about", "number long, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [row for batch in rows for row in zip(batch["order"], batch["text"], batch["turn"], batch["at"], strict=True)]
        if not key[0] or not key[0].strip():
            return
        number, newest = self.about.get() if self.about.exists() else (0, None)
        held = [(v[0], k[0], v[1]) for k, v in self.turns.iterator()] if number else []
        state, out = Turns(held, number, newest, self.n, self.ttl, self.delay), []
        for _, text, turn, at in sorted(came, key=lambda r: (r[0], r[1] or "")):
            norm = normalise(text)
            if norm:
                known = self.timed and not pd.isna(at)
                when = int(at) if known else state.newest if self.timed and state.newest is not None else self.now()
                window = state.add(norm, when)
                out.append((key[0], turn, window, window is None))
        new, old = state.changes()
        for at, seq, text in new:
            self.turns.updateValue((seq,), (at, text))
        for seq in old:
            self.turns.removeKey((seq,))
        if state.newest is not None:
            self.about.update((state.number, state.newest))
        if self.drop_idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl + (self.delay or 0))
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "turn", "window", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.turns.clear()
        self.about.clear()
        return iter(())

    def close(self) -> None:
        pass


def timed_windows(turns: DataFrame, n: int = TURNS, ttl: int = TTL_SECONDS, ts: str | None = None, delay: int | None = None, order: str = "turn", now: Callable[[], int] | None = None, drop_idle: bool = True) -> DataFrame:
    """(conv_id, turn, window, late) for a stream of (conv_id string, turn long, text string and the columns named).

    ts: a timestamp column; delay: seconds by which a turn may be older than the newest before it. n <= 0 and ttl <= 0
    stand for the defaults. drop_idle: the state of a conversation goes after ttl and delay without a turn; its timer keeps
    a query running batches without data, and a run over what is there (availableNow) has no use for it.
    """
    n, ttl = min(n if n > 0 else TURNS, MOST_TURNS), ttl if ttl > 0 else TTL_SECONDS
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    clock = now or (lambda: int(time.time() * 1000))
    rows = turns.select(F.coalesce("conv_id", F.lit("")).alias("conv_id"), "turn", "text", F.col(order).cast("long").alias("order"), (F.unix_millis(ts) if ts else F.lit(None).cast("long")).alias("at"))
    return rows.groupBy("conv_id").transformWithStateInPandas(WindowProcessor(n, ttl, delay if ts else None, ts is not None, clock, drop_idle), "conv_id string, turn long, window string, late boolean", "append", "ProcessingTime" if drop_idle else "None")


def windows(turns: DataFrame, n: int = TURNS, ttl: int = TTL_SECONDS, now: Callable[[], int] | None = None, drop_idle: bool = True, **options) -> DataFrame:
    """(conv_id, turn, window) of the turns of a stream that aren't late; see `timed_windows`."""
    return timed_windows(turns, n, ttl, now=now, drop_idle=drop_idle, **options).where("not late").drop("late")


def cross_turn(turns: DataFrame, wordlist: DataFrame | None = None, **options) -> DataFrame:
    """(conv_id, turn, types): certain secrets in each window of a stream, as it is and without its spaces."""
    from ..plans.inspection import detect

    rows = windows(turns, **options)
    both = rows.select("conv_id", "turn", F.explode(F.array_distinct(F.array(F.col("window"), F.regexp_replace("window", "\\s+", "")))).alias("variant"))
    types = F.transform(F.filter("secrets", lambda x: x["risk_level"] == "CRITICAL"), lambda x: x["entity_type"])
    return detect(both, "variant", wordlist).select("conv_id", "turn", types.alias("types")).where(F.size("types") > 0)


def inspect_batches(write_decisions: Callable[[DataFrame], None], write_audit: Callable[[DataFrame], None] | AuditLog, audit_failed: Callable[[Exception, int], None] | None = None, **options) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: inspects each batch and hands on decisions, then events. A failing audit never costs a decision.

    An AuditLog gets the batch's number too, so a batch that is run again after a failure leaves its events once. That is
    why its failure is raised, once the decisions are written: a log that lacks a batch can't be told from a whole one. The
    failure of a function is printed, and the stream goes on. audit_failed: gets the failure and the batch's number instead.
    """
    from ..plans.inspection import audit_events, inspect

    def lost(failure: Exception, number: int) -> None:
        if isinstance(write_audit, AuditLog):
            raise failure
        print(f"audit of batch {number} failed: {type(failure).__name__}")

    def each(batch: DataFrame, number: int) -> None:
        decisions = inspect(batch, **options).persist()
        try:
            write_decisions(decisions)
            try:
                events = audit_events(decisions, options.get("id_col", "doc_id"))
                write_audit.write(events, number) if isinstance(write_audit, AuditLog) else write_audit(events)
            except Exception as e:  # noqa: BLE001
                (audit_failed or lost)(e, number)
        finally:
            decisions.unpersist()

    return each


def run_available(stream: DataFrame, at: str, **options: str) -> DataFrame:
    """Runs a stream over what is there, into the folder `at`; its rows, read from there. A run that failed goes on from its checkpoint."""
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")
