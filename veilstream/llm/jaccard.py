"""N-gram Jaccard join by PartEnum signatures, and the classes of near duplicates that it links.

Two sets of x <= y shingles with a Jaccard similarity of 3/4 or more differ in k = (x + y) / 7 elements at most. Sizes
fall into bands [l, 4l/3], so similar sets lie in one band or in neighbouring ones. For each band the domain of hashes
is cut into partitions, and each of these into three parts. In some partition two similar sets differ in one element
at most, where there are more than k / 2 of them; so they agree on two of its three parts. Every choice of two parts
is a signature: the hash of a set's elements in them.

Parts in which both sets are empty tell nothing, and parts that hold only very frequent shingles tell little. So only
choices that hold an element which isn't frequent give signatures, and only partitions in which every choice does
count for the guarantee. Where a set hasn't enough of those, it also gives signatures for the next mode (more
partitions, at last frequent elements too, at last single elements). Two sets meet in the first mode that is enough
for either, so no link is lost.

Sets that are equal are one class from the start, found by an aggregate; only classes are joined. The classes that
share a signature aren't compared all with all: first each with the least of its group, the hub, then only members
of different components that the group still holds. Large groups are dealt over many tasks in pieces of bounded
size, and a piece gives one link for each set and component at most.

Defined results: without words or text a set is empty and linked with nothing. Rows that repeat a document are in
its class; so are rows without id. A very long text is one set like others, hashed in stretches. An empty table
gives an empty result. Only the id and what the join finds come back from `near_classes`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, fresh, materialize, table
from .shingles import identity, mixed, shingles

#: Shingles in this many documents or more are frequent. Whatever counts as frequent, results are the same.
FREQUENT = 256
#: A task counts shingles over this many elements at a time, and reports those found this often.
COUNT_CHUNK, COUNT_LEAST = 1_000_000, 4
#: The list of frequent shingles that is broadcast has this many entries at most: its size bound is 8 bytes times that.
FREQUENT_MOST = 1_000_000
#: Modes: whether frequent elements count; partitions times elements that may differ in one, as a multiple of those needed
#: at least (0: one an element); parts of a partition; elements that may differ in one.
MODES = ((False, 1.15, 3, 1), (False, 1.7, 3, 1), (False, 3.0, 1, 0), (True, 1.15, 3, 1), (True, 1.7, 3, 1), (True, 3.0, 1, 0), (True, 0.0, 1, 0))
#: Signatures that one block of the signature shuffle holds, about, and those that a task holds before it deals them.
BLOCK_SIGNATURES, HELD_SIGNATURES = 150_000, 300_000
#: Bytes kept of a signature beside its block. Chance matches grow with the input, as blocks do, and are verified.
KEPT_BYTES = 4
#: Sizes travel beside signatures as whole logarithms to this base, a byte each; sizes of linked sets differ in 4 at most.
SIZE_BASE, SIZE_STEPS = 1.1, 4
#: A list of up to this many rows of a few numbers is broadcast to fetch texts or sets; a longer one is joined by shuffling.
BROADCAST_ROWS = 1_000_000
#: Sets, and elements of sets, in one piece of a group, about.
PIECE, PIECE_ELEMENTS = 1024, 400_000
#: Rows in a record batch.
BATCH = 50_000

_U = np.uint64


def linked(x, y, both):
    """Jaccard similarity of 3/4 or more."""
    return 100 * both >= 75 * (x + y - both)


@lru_cache(maxsize=100_000)
def band_end(x: int) -> int:
    """The largest size in the band of size x."""
    low = 1
    while (end := low * 4 // 3) < x:
        low = end + 1
    return end


@lru_cache(maxsize=100_000)
def bounds(n: int) -> np.ndarray:
    return (np.arange(1, n, dtype=np.float64) * (2.0**64 / n)).astype(np.uint64)


def _instance(found: np.ndarray, sums: np.ndarray, rare: np.ndarray, end: int, differ: int, probe: bool) -> list[np.ndarray]:
    """Signatures of a set in the band that ends at `end`, when it differs from partners in `differ` elements at most."""
    out = []
    for mode, (every, factor, parts, apart) in enumerate(MODES):
        if not factor:
            out.append(_named(found, found, mode, end))
            break
        n = int(np.ceil(factor * (2 * end // 7 + 1) / (apart + 1)))
        at = np.concatenate(([0], np.searchsorted(found, bounds(n * parts)), [len(found)]))
        values = (sums[at[1:]] - sums[at[:-1]]).reshape(n, parts)
        full = (at[1:] > at[:-1] if every else rare[at[1:]] > rare[at[:-1]]).reshape(n, parts)
        strong = full.sum(axis=1) > apart
        enough = int(strong.sum()) * (apart + 1) > differ
        if enough and probe:  # partners give all of theirs, so partitions that are just enough will do
            strong[np.flatnonzero(strong)[differ // (apart + 1) + 1 :]] = False
            full &= strong[:, None]
        for k, chosen in enumerate(combinations(range(parts), parts - apart)):
            use = np.flatnonzero(full[:, chosen].any(axis=1))
            out.append(_named(values[:, chosen].sum(axis=1, dtype=np.uint64)[use], (use * 16 + k).astype(np.uint64), mode, end))
        if enough:
            break
    return out


def _named(values: np.ndarray, choice: np.ndarray, mode: int, end: int) -> np.ndarray:
    return mixed(values + mixed(choice * _U(64) + _U(mode)) + mixed(np.array([end], np.uint64)))


def signatures(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    x = len(found)
    if x < 2:
        return np.empty(0, np.uint64)
    sums = np.zeros(x + 1, np.uint64)
    np.cumsum(found, out=sums[1:])
    rare = np.arange(x + 1)
    if len(frequent):
        near = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)]
        rare = np.concatenate(([0], np.cumsum(near != found)))
    end, most = band_end(x), x * 4 // 3
    out = []
    if differ := (x + min(end, most)) // 7:
        out += _instance(found, sums, rare, end, differ, False)
    if most > end:
        out += _instance(found, sums, rare, band_end(end + 1), (x + most) // 7, True)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's (id, key of the text, n_shingles, set); kind 1: a shingle (as set) and how many documents here have it."""
    held: list = []
    size = 0

    def rows(kind, ids, keys, ns, hs) -> pa.RecordBatch:
        return pa.record_batch([pa.array([kind] * len(ids), pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, keys, ns, hs))], names=["kind", "doc_id", "key", "n", "set"])

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= COUNT_LEAST
        none = np.zeros(often.sum(), np.int64)
        return rows(1, none, none, counts[often], values[often].view(np.int64))

    for batch in batches:
        ns, hs = [], []
        for t in batch.column("text"):
            found = shingles(t.as_py())
            ns.append(len(found))
            hs.append(identity(found) if len(found) else None)
            held.append(found)
            size += len(found)
            if size >= COUNT_CHUNK:
                yield counted()
                held, size = [], 0
        yield rows(0, batch.column("doc_id"), batch.column("key"), ns, hs)
    if size:
        yield counted()


def _sign(frequent, blocks: int):
    """Rows (block, sets, sizes, sigs): a block's signatures, each with its set and the set's size as a logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task sign once
        hs, ns, lens, sigs = [], [], [], []
        held = 0

        def flush() -> pa.RecordBatch:
            sig, of = np.concatenate(sigs), np.repeat(np.arange(len(hs), dtype=np.uint32), lens)
            block = (sig % _U(blocks)).astype(np.uint32)
            order = np.argsort(block)
            of, block = of[order], block[order]
            sig = (sig[order] // _U(blocks)).view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES]
            h, n = np.array(hs, np.int64), np.array([min(255, int(math.log(x, SIZE_BASE))) for x in ns], np.uint8)
            out: list[list] = [[], [], [], []]
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
            for s, e in zip(edges, edges[1:], strict=False):
                for to, x in zip(out, (block[s], h[of[s:e]].tobytes(), n[of[s:e]].tobytes(), sig[s:e].tobytes()), strict=True):
                    to.append(x)
            return pa.record_batch([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["block", "sets", "sizes", "sigs"])

        for batch in batches:
            for t in batch.column("text"):
                found = shingles(t.as_py())
                h = identity(found)
                if not len(found) or h in seen:
                    continue
                seen.add(h)
                got = signatures(found, frequent.value)
                if len(got):
                    hs.append(h)
                    ns.append(len(found))
                    lens.append(len(got))
                    sigs.append(got)
                    held += len(got)
                if held >= HELD_SIGNATURES:
                    yield flush()
                    hs, ns, lens, sigs, held = [], [], [], [], 0
        if held:
            yield flush()

    return run


def _share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block. (grp, hub, hub_x, set, x) for every set of a group that shares a signature.

    Groups of the same sets have the same name; such a group comes once a block. x: the logarithm of the set's size.
    """

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        sets, xs, kept = (np.concatenate(x) for x in zip(*rows, strict=True))
        kept = kept.reshape(-1, KEPT_BYTES)
        sigs = np.zeros((len(kept), 8), np.uint8)
        sigs[:, :KEPT_BYTES] = kept
        sigs = sigs.view(np.uint64).ravel()
        order = np.argsort(sigs)
        alike = sigs[order[1:]] == sigs[order[:-1]]
        order = order[np.concatenate(([False], alike)) | np.append(alike, False)]
        if not len(order):
            return
        sets, xs, sigs = sets[order], xs[order], sigs[order]
        order = np.lexsort((sets, sigs))
        sets, xs, sigs = sets[order], xs[order], sigs[order]
        new = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (sets[1:] != sets[:-1])))
        sets, xs, sigs = sets[new], xs[new], sigs[new]
        starts = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        many = np.diff(np.append(starts, len(sigs)))
        name = mixed(np.add.reduceat(mixed(sets.view(np.uint64)), starts) + many.astype(np.uint64)).view(np.int64)
        _, once = np.unique(name, return_index=True)
        once = once[many[once] > 1]
        starts, many, name = starts[once], many[once], name[once]
        of = np.repeat(np.arange(len(starts)), many)
        at = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(len(of))
        cols = (name[of], sets[starts][of], xs[starts][of], sets[at], xs[at])
        for k in range(0, len(of), BATCH):
            yield pa.record_batch([pa.array(c[k : k + BATCH], pa.int64()) for c in cols], names=["grp", "hub", "hub_x", "set", "x"])

    rows: list = []
    last = None
    for batch in batches:
        for b, *row in zip(batch.column("block").to_pylist(), *(batch.column(k) for k in ("sets", "sizes", "sigs")), strict=True):
            if b != last and rows:
                yield from flush(rows)
                rows = []
            last = b
            rows.append([np.frombuffer(x.as_py(), t) for x, t in zip(row, (np.int64, np.uint8, np.uint8), strict=True)])
    if rows:
        yield from flush(rows)


def sketch(found: np.ndarray) -> np.ndarray:
    """How many elements begin with each pattern of bits; about two a pattern, so it's much smaller than the set."""
    bits = max(0, (len(found) // 2).bit_length() - 1)
    while True:
        counts = np.bincount((found >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) if bits else np.array([len(found)])
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        bits += 1


def most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """No two sets with these sketches share more elements than this."""
    while len(a) != len(b):
        if len(a) > len(b):
            a, b = b, a
        b = b.astype(np.int64).reshape(-1, 2).sum(axis=1)
    return int(np.minimum(a, b).sum())


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        found = []
        for h, t in zip(batch.column("set").to_pylist(), batch.column("text"), strict=True):
            if h not in seen and identity(x := shingles(t.as_py())) == h:
                seen.add(h)
                found.append((h, x))
        yield pa.record_batch([pa.array([h for h, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary()), pa.array([sketch(x).tobytes() for _, x in found], pa.binary())], names=["set", "elements", "sketch"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("p"), batch.column("q"), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8)
            keep.append(bool(linked(int(x.sum(dtype=np.int64)), int(y.sum(dtype=np.int64)), most_shared(x, y))))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["hub", "hub_x", "set"])


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, hub_x, set) that their sketches don't rule out, before any set is moved."""
    of = lambda key, name: sets.select(F.col("set").alias(key), F.col("sketch").alias(name)).dropDuplicates([key])
    both = pairs.join(of("hub", "p"), "hub").join(of("set", "q"), "set").select("hub", "hub_x", "set", "p", "q")
    return materialize(both.mapInArrow(_possible, "hub long, hub_x long, set long"), "jaccard-close")


_DEALT = ("grp", "piece", "side", "set", "comp")


class _Bases:
    """The bases of a piece: elements in one sorted array."""

    def __init__(self, names: list[int], comps: list[int], parts: list[np.ndarray]):
        self.names, self.comps, self.sizes = np.array(names), np.array(comps), np.array([len(p) for p in parts])
        every, of = np.concatenate(parts), np.repeat(np.arange(len(names), dtype=np.int32), self.sizes)
        order = np.argsort(every)
        self.every, self.of = every[order], of[order]

    def links(self, found: np.ndarray, comp: int) -> np.ndarray:
        """Names of bases that link with a set, one of each component other than its own."""
        lo, hi = np.searchsorted(self.every, found, "left"), np.searchsorted(self.every, found, "right")
        many = hi - lo
        at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(self.of[at], minlength=len(self.names))
        k = np.flatnonzero(linked(self.sizes, len(found), both) & (self.comps != comp))
        return self.names[k[np.unique(self.comps[k], return_index=True)[1]]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (grp, piece, side): bases (side 0), then the probes that are held against them."""
    key, bases, ready = None, ([], [], []), None
    for batch in batches:
        a, b = [], []
        for grp, piece, side, h, comp, raw in zip(*(batch.column(k).to_pylist() for k in _DEALT), batch.column("payload"), strict=True):
            if (grp, piece) != key:
                key, bases, ready = (grp, piece), ([], [], []), None
            found = np.frombuffer(raw.as_py(), np.uint64)
            if side == 0:
                for to, x in zip(bases, (h, comp, found), strict=True):
                    to.append(x)
            elif bases[0]:
                ready = ready or _Bases(*bases)
                near = ready.links(found, comp)
                a.extend(near.tolist())
                b.extend([h] * len(near))
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Sketches:
    """The sketches of a piece's bases, as a matrix for each length."""

    def __init__(self, names: list[int], comps: list[int], parts: list[np.ndarray]):
        self.names, self.comps, by = np.array(names), np.array(comps), {}
        for k, p in enumerate(parts):
            by.setdefault(len(p), []).append(k)
        self.by = {n: (np.array(ks), np.stack([parts[k] for k in ks])) for n, ks in by.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def may_link(self, mine: np.ndarray, comp: int) -> np.ndarray:
        """Which bases of other components a set with this sketch may link with."""
        out = [np.empty(0, np.int64)]
        size = int(mine.sum(dtype=np.int64))
        for n, (ks, m) in self.by.items():
            if max(n, len(mine)) > 8 * min(n, len(mine)):  # sizes too far apart, see `sketch`
                sizes = m.sum(axis=1, dtype=np.int64)
                if not (4 * np.minimum(sizes, size) >= 3 * np.maximum(sizes, size)).any():
                    continue
            to = min(n, len(mine))
            if (n, to) not in self.folded:
                self.folded[n, to] = m if n == to else m.reshape(len(m), to, -1).sum(axis=2, dtype=np.uint16)
            own = mine if len(mine) == to else mine.reshape(to, -1).sum(axis=1, dtype=np.uint16)
            both = np.minimum(self.folded[n, to], own).sum(axis=1, dtype=np.int64)
            ok = linked(m.sum(axis=1, dtype=np.int64), size, both) & (self.comps[ks] != comp)
            out.append(ks[ok])
        return np.concatenate(out)


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as for `_compare`, with sketches; (grp, side, set) of bases and probes that have a partner they may link with."""
    key, bases, ready, able = None, ([], [], []), None, None

    def out() -> pa.RecordBatch:
        names = ready.names[able].tolist() if ready else []
        rows = [*((0, h) for h in names), *((1, h) for h in probes)]
        return pa.record_batch([pa.array([key[0]] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["grp", "side", "set"])

    probes: list[int] = []
    for batch in batches:
        for grp, piece, side, h, comp, raw in zip(*(batch.column(k).to_pylist() for k in _DEALT), batch.column("payload"), strict=True):
            if (grp, piece) != key:
                if probes:
                    yield out()
                key, bases, ready, probes = (grp, piece), ([], [], []), None, []
            mine = np.frombuffer(raw.as_py(), np.uint8)
            if side == 0:
                for to, x in zip(bases, (h, comp, mine), strict=True):
                    to.append(x)
            elif bases[0]:
                if ready is None:
                    ready = _Sketches(*bases)
                    able = np.zeros(len(bases[0]), bool)
                near = ready.may_link(mine, comp)
                if len(near):
                    able[near] = True
                    probes.append(h)
    if probes:
        yield out()


def _dealt(bases: DataFrame, probes: DataFrame, payload: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, piece, side, set, comp, payload), sorted: bases (side 0) and probes (side 1) of a group, with (set, payload); and the table they read.

    bases: (grp, set, comp, x), x the logarithm of the size; probes: (grp, set, comp). A group is cut into pieces of bounded size on both sides;
    each base piece meets each probe piece once.
    """
    nb = bases.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PIECE), F.ceil(F.sum(F.pow(F.lit(SIZE_BASE), "x")) / PIECE_ELEMENTS)).cast("int").alias("nb"))
    np_ = probes.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("np"))
    cut = nb.join(np_, "grp")
    dealt = lambda side, own, many: F.sequence(F.lit(0), F.col(many) - 1) if side != own else F.array(F.pmod(F.xxhash64("set"), F.col(many)).cast("int"))
    rows = [df.select("grp", "set", "comp").join(cut, "grp").select("grp", F.lit(side).alias("side"), "set", "comp", F.explode(dealt(side, 0, "nb")).alias("pb"), "np").select("grp", "side", "set", "comp", "pb", F.explode(dealt(side, 1, "np")).alias("pp")) for side, df in enumerate((bases, probes))]
    both = materialize(rows[0].union(rows[1]).withColumn("piece", F.xxhash64("pb", "pp")), "jaccard-dealt")
    few = F.broadcast(both) if both.count() <= BROADCAST_ROWS else both
    return payload.join(few, "set").select(*_DEALT, "payload").repartition(parts, "grp", "piece").sortWithinPartitions("grp", "piece", "side"), both


def _links(bases: DataFrame, probes: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Links (a, b) between bases and probes of one group, by their elements."""
    dealt, read = _dealt(bases, probes, sets.select("set", F.col("elements").alias("payload")), parts)
    found = materialize(dealt.mapInArrow(_compare, "a long, b long").distinct(), "jaccard-links")
    discard(read)
    return found


def _classes(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key of the text, n_shingles, set) of docs; (set, class) of sets that are linked, class a set; and the table that the rows are in.

    Every other table is deleted as soon as what is made of it is written.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")).withColumn("key", F.xxhash64("text"))
    described = materialize(texts.select("doc_id", "key", "text").mapInArrow(_describe, "kind int, doc_id long, key long, n long, set long"), "jaccard-sets")
    rows = described.where("kind = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), "set")
    counts = materialize(described.where("kind = 1").groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "jaccard-frequent")
    least = FREQUENT
    while counts.where(F.col("n") >= least).count() > FREQUENT_MOST:
        least *= 2
    frequent = np.sort(np.array([r[0] for r in counts.where(F.col("n") >= least).select("set").collect()], np.int64).view(np.uint64))
    discard(counts)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(4 * parts, -(-total // BLOCK_SIGNATURES))
    signed = texts.select("text").mapInArrow(_sign(spark.sparkContext.broadcast(frequent), blocks), "block int, sets binary, sizes binary, sigs binary")
    dealt = signed.repartition(max(parts, blocks // 8), "block").sortWithinPartitions("block")
    members = dealt.mapInArrow(_share, "grp long, hub long, hub_x long, set long, x long")
    members = materialize(members.dropDuplicates(["grp", "set"]), "jaccard-members")
    # the elements of the sets that take part, from one document of each
    one = rows.where("set is not null").groupBy("set").agg(F.min(F.struct("key", "doc_id")).alias("one"))
    chosen = materialize(members.select("set").distinct().join(one, "set").select("set", F.col("one.key").alias("_key"), F.col("one.doc_id").alias("_id")), "jaccard-chosen")
    few = F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen
    sets = texts.join(few, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("set", "text")
    sets = materialize(sets.mapInArrow(_elements, "set long, elements binary, sketch binary"), "jaccard-elements")
    discard(chosen)
    pairs = members.where((F.col("set") != F.col("hub")) & (F.abs(F.col("x") - F.col("hub_x")) <= SIZE_STEPS)).groupBy("hub", "hub_x", "set").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs, "jaccard-pairs")

    def held(pairs: DataFrame) -> DataFrame:
        close = _close(pairs.select("hub", "hub_x", "set"), sets)
        hubs = close.select(F.col("hub").alias("grp"), F.col("hub").alias("set"), F.col("hub").alias("comp"), F.col("hub_x").alias("x")).distinct()
        found = _links(hubs, close.select(F.col("hub").alias("grp"), "set", F.col("set").alias("comp")), sets, parts)
        discard(close)
        return found

    # each set with the hub of most of its groups; then with other hubs that are still apart from it
    most = pairs.groupBy("set").agg(F.max_by(F.struct("hub", "hub_x"), F.struct("n", "hub")).alias("most"))
    links = held(most.select("most.hub", "most.hub_x", "set"))
    label = materialize(components(links), "jaccard-labels")
    of = lambda key, name: label.select(F.col("node").alias(key), F.col("component").alias(name))
    rest = pairs.join(of("set", "p"), "set", "left").join(of("hub", "q"), "hub", "left").where(F.coalesce("p", "set") != F.coalesce("q", "hub"))
    rest = rest.join(most.select("set", "most.hub"), ["set", "hub"], "left_anti")
    links = links.union(held(rest))
    first, label = label, materialize(components(links), "jaccard-labels")
    discard(first, pairs)
    # Groups that still hold several components: what isn't in the hub's is held against the others, once for all
    # such groups with a hub in that component, as they have most of their sets in common.
    now = members.join(of("set", "comp"), "set", "left").join(of("hub", "home"), "hub", "left")
    now = now.select("grp", "set", "x", F.coalesce("comp", "set").alias("comp"), F.coalesce("home", "hub").alias("home"))
    apart = now.where("comp != home").select("grp").distinct()
    now = materialize(now.join(apart, "grp", "left_semi").select(F.col("home").alias("grp"), "set", "x", "comp", (F.col("comp") != F.col("home")).alias("probe")).distinct(), "jaccard-apart")
    discard(members)
    bases, probes = now.select("grp", "set", "comp", "x"), now.where("probe").select("grp", "set", "comp")
    dealt, read = _dealt(bases, probes, sets.select("set", F.col("sketch").alias("payload")), parts)
    able = materialize(dealt.mapInArrow(_may_link, "grp long, side int, set long").distinct(), "jaccard-able")
    discard(read)
    more = _links(bases.join(able.where("side = 0"), ["grp", "set"], "left_semi"), probes.join(able.where("side = 1"), ["grp", "set"], "left_semi"), sets, parts)
    discard(able, now, sets)
    if not more.isEmpty():
        label = components(links.union(more))
    return rows, label.select(F.col("node").alias("set"), F.col("component").alias("class")), described


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set, component_id) for every row of docs: the near-duplicate class of each document."""
    rows, label, _ = _classes(docs, id_col, text)
    own = rows.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least")).join(label, "set", "left").withColumn("class", F.coalesce("class", "set"))
    ids = own.join(own.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("set", "component_id")
    return rows.join(ids, "set", "left").select("doc_id", "n_shingles", "set", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class stays, with all its columns: the one with the smallest id, one without id last.

    Of rows with that id the one whose text has the least hash stays, of rows that repeat it one. Documents without
    words are in no class: all stay, but of rows that repeat id and text one does.
    """
    rows, label, described = _classes(docs, id_col, text)
    rows = rows.groupBy("doc_id", "key", "set").agg(F.count(F.lit(1)).alias("times"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    own = rows.where("set is not null").groupBy("set").agg(F.min(order).alias("first")).join(label, "set", "left").withColumn("class", F.coalesce("class", "set"))
    stays = own.join(own.groupBy("class").agg(F.min("first").alias("stay")), "class").select("set", "stay")
    judged = rows.join(stays, "set", "left").withColumn("goes", F.coalesce(order != F.col("stay"), F.lit(False)))
    own_id, own_key = fresh(docs, "of_id"), fresh(docs, "of_key")
    judged = materialize(judged.where("goes or times > 1").select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), "goes"), "jaccard-judged")
    discard(described)
    ids, keys = F.col(id_col).cast("long"), F.xxhash64(F.col(text).cast("string").cast("binary"))
    same = ids.eqNullSafe(F.col(own_id)) & keys.eqNullSafe(F.col(own_key))
    again = judged.where("not goes").drop("goes")
    gone = judged.drop("goes")
    single = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
    if again.isEmpty():
        return single
    repeated = docs.join(again, same, "left_semi").withColumns({own_id: ids, own_key: keys}).dropDuplicates([own_id, own_key])
    return single.unionByName(repeated.select(*docs.columns))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the near-duplicate classes of all documents."""
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
