"""Benchmark decontamination with an FM-index per training shard.

A benchmark item is cut into windows of 10 words (a shorter item is one window). Each task packs documents into
shards of bounded size, builds an FM-index over a shard's words (Burrows-Wheeler transform, rank by a wavelet
matrix, sampled suffix positions), searches all windows backwards at once, locates their occurrences, and merges
them into removal spans for each document. Documents never move between machines.

Words outside the benchmark's vocabulary can't be part of a window. They all become one separator, and runs of
vocabulary words shorter than the shortest window leave the index; no occurrence is lost by that.

The benchmark reaches the tasks in blocks of bounded size: the driver reads one, broadcasts it, and drops it before
it reads the next. With more than one block, each block's hits are written by the text's MD5 sum before the next
block comes, and joined in the end, so a benchmark of any size works with bounded memory.

Defined results: a null or empty text has no words and no hits; an item without words has no windows; an item without
id has the empty name. Rows that repeat a document, and items that repeat a text under another id, are each reported.
A very long document is a shard of its own. Empty tables give empty results or no hits. Of the input's columns `find`
keeps the id only; `drop_contaminated` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, fresh, materialize, table

WINDOW = 10
#: Benchmark words in a block, at most (but for a single longer item).
BLOCK_WORDS = 2_000_000
#: Indexed words in a shard, at most (but for a single longer document).
SHARD_WORDS = 1_000_000
#: Text bytes in a shard, at most (but for a single longer document).
SHARD_BYTES = 32_000_000
#: Each how many words of a shard a suffix position is kept.
SAMPLE_EVERY = 16


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class FmIndex:
    """FM-index of a sequence of symbols 1..sigma-1; 0 is a separator, which no pattern holds. The last symbol is 0."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.sigma, n = sigma, len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1]  # of suffix 0: the last symbol, a separator
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma))))
        self.levels, self.zeros = [], []
        bits, rest = max(1, int(sigma - 1).bit_length()), bwt
        for k in range(bits - 1, -1, -1):
            bit = (rest >> k) & 1
            self.levels.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(n - int(self.levels[-1][-1]))
            rest = np.concatenate((rest[bit == 0], rest[bit == 1]))
        # positions kept: every SAMPLE_EVERY-th, and those after a separator, where a walk must end
        kept = (sa % SAMPLE_EVERY == 0) | (bwt == 0)
        self.marked, self.samples, self.bwt = kept, np.where(kept, sa, -1), bwt

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often symbol stands before row upto of the transform."""
        lo, hi = np.zeros_like(upto), upto
        for level, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = ((symbol >> (len(self.levels) - 1 - level)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the rows of patterns (m, length) that occur; by backward search."""
        which = np.arange(len(patterns))
        last = patterns[:, -1]
        lo, hi = self.starts[last], self.starts[last + 1]
        for t in range(patterns.shape[1] - 2, -1, -1):
            alive = lo < hi
            which, lo, hi = which[alive], lo[alive], hi[alive]
            if not len(which):
                break
            c = patterns[which, t]
            lo, hi = self.starts[c] + self.rank(c, lo), self.starts[c] + self.rank(c, hi)
        alive = lo < hi
        return which[alive], lo[alive], hi[alive]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of rows of the transform: walk back to a kept position."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = at[todo]
            done = self.marked[here]
            out[todo[done]] = self.samples[here[done]] + steps[todo[done]]
            todo = todo[~done]
            c = self.bwt[at[todo]]
            at[todo] = self.starts[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling. Separators differ from each other by position, so comparisons end at the next one."""
    n = len(seq)
    sep = seq == 0
    rank = np.where(sep, np.cumsum(sep) - 1, seq.astype(np.int64) + int(sep.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
        if new.max(initial=0) == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = new[step:] + 1
        rank = new * (n + 1) + ahead
        order = np.argsort(rank, kind="stable")
        step *= 2


class Phrases:
    """The windows of a block of items: by length, the patterns and the items of each."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.by_length = {size: (np.array(list(p), np.int64), [sorted(x) for x in p.values()]) for size, p in found.items()}
        self.shortest = min(self.by_length, default=0)

    def shard(self, docs: list[np.ndarray]) -> list[tuple[list, list[tuple[int, int]]]]:
        """For each document (its words' ids, 0: none): items, and merged spans of hit words."""
        out: list[tuple[list, list]] = [([], []) for _ in docs]
        if not self.by_length or not docs:
            return out
        seq, doc, word = [], [], []
        for d, ids in enumerate(docs):
            known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
            edge = np.diff(known)
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                if e - s >= self.shortest:
                    seq += [ids[s:e], [0]]
                    doc.append(np.full(e - s + 1, d))
                    word.append(np.arange(s, e + 1))
        if not seq:
            return out
        seq, doc, word = np.concatenate(seq).astype(np.int64), np.concatenate(doc), np.concatenate(word)
        index = FmIndex(seq, len(self.vocabulary) + 1)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        items: dict[int, set] = {}
        for size, (patterns, owners) in self.by_length.items():
            which, lo, hi = index.search(patterns)
            many = hi - lo
            rows = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            at = index.locate(rows)
            hits.append((doc[at], word[at], word[at] + size))
            for d, p in set(zip(doc[at].tolist(), np.repeat(which, many).tolist(), strict=True)):
                items.setdefault(d, set()).update(owners[p])
        d, s, e = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((s, d))
        for d1, s1, e1 in zip(d[order].tolist(), s[order].tolist(), e[order].tolist(), strict=True):
            spans = out[d1][1]
            if spans and s1 <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(e1, spans[-1][1]))
            else:
                spans.append((s1, e1))
        for d1, found in items.items():
            out[d1][0].extend(found)
        return out


SCHEMA = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])


def _search(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = block.value
        known = phrases.vocabulary.get
        pending: list = []

        def flush() -> Iterator[pa.RecordBatch]:
            if pending:
                found = phrases.shard([x[2] for x in pending])
                rows = [(i, key, len(ws), items, [list(x) for x in spans]) for (i, key, ws), (items, spans) in zip(pending, found, strict=True)]
                pending.clear()
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

        size = held = 0
        for batch in batches:
            for i, key, t in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), batch.column("text"), strict=True):
                ids = np.array([known(w, 0) for w in words(t.as_py())], np.int64)
                pending.append((i, key, ids))
                size += np.count_nonzero(ids)
                held += 8 * len(ids)
                if size >= SHARD_WORDS or held >= SHARD_BYTES:
                    yield from flush()
                    size = held = 0
        yield from flush()

    return run


def blocks(benchmark: DataFrame, item_col: str, text: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The items, in blocks of bounded size, each read by the driver on its own."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        ws = words(bytes(r["text"]))
        held.append((r["item"], ws))
        size += len(ws)
        if size >= block_words:
            yield Phrases(held, window)
            held, size = [], 0
    yield Phrases(held, window)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, item_ids array<string>, spans array<struct<start, end>>) for every row of docs.

    Spans are of words that stand inside an occurrence of a window: merged, in order, end exclusive.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text")).withColumn("key", F.unhex(F.md5("text"))).select("id", "key", "text")
    search = lambda block: rows.mapInArrow(_search(spark.sparkContext.broadcast(block)), "id long, key binary, n_words long, items array<string>, spans array<array<long>>")
    source = blocks(benchmark, item_col, item_text, window, block_words)
    found = search(next(source))
    more: list[DataFrame] = []
    for block in source:
        if not more:
            found = materialize(found, "decontamination-first")
        more.append(materialize(search(block).where(F.size("spans") > 0).dropDuplicates(["key"]).select("key", F.col("items").alias("others"), F.col("spans").alias("also")), "decontamination-hits"))
    if more:
        hits = reduce(DataFrame.union, more).groupBy("key").agg(F.flatten(F.collect_list("others")).alias("others"), F.flatten(F.collect_list("also")).alias("also"))
        both = lambda a, b: F.concat(a, F.coalesce(b, F.array().cast(found.schema[a].dataType)))
        found = found.join(hits, "key", "left").select("id", "key", "n_words", both("items", F.col("others")).alias("items"), merged(both("spans", F.col("also"))).alias("spans"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.array_sort(F.array_distinct("items")).alias("item_ids"), F.transform("spans", lambda x: F.struct(x[0].alias("start"), x[1].alias("end"))).alias("spans"))


def merged(spans: Column) -> Column:
    """Spans [start, end] in order, those that touch or overlap as one."""
    ordered, none = F.array_sort(spans), F.array().cast("array<array<long>>")

    def put(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))
        return F.when(F.size(done) == 0, F.array(x)).when(x[0] <= last[1], joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(ordered, none, put)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without any hit, with all their columns. Of rows that share an id, or have none, those with a hit go."""
    spans = find(docs.select(F.xxhash64(id_col, text).alias("row"), text), benchmark, id_col="row", text=text, **options)
    name = fresh(docs, "hit")
    hit = spans.where(F.size("spans") > 0).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, F.xxhash64(id_col, text) == F.col(name), "left_anti")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the search of all benchmark items in all documents."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


#: The same in SQL: windows joined by their words; ids are unique in the tables.
OP7_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, w[i:i + least({WINDOW}, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
heads AS (SELECT DISTINCT win[1] AS head, size FROM bw),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
may AS (SELECT dp.doc_id, dp.i, heads.size FROM dp JOIN heads ON heads.head = dp.word),
runs AS (SELECT may.doc_id, i, size, d.w[i:i + size - 1] AS win FROM may JOIN d ON d.doc_id = may.doc_id WHERE i + size - 1 <= len(d.w)),
hit AS (SELECT runs.doc_id, runs.i, bw.size, bw.item_id FROM runs JOIN bw ON bw.size = runs.size AND bw.win = runs.win),
n AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
