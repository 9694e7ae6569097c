"""Suffix-array dedup: bytes covered by strings of 400 bytes that start elsewhere too.

Every 400-byte string is filed under one anchor: the 32-byte gram in it with the least hash (the leftmost of
equals). Equal strings have equal anchors at equal offsets, so only texts that share an anchor need comparing. A
text's starts that fall to one anchor are consecutive, and so are those of anchors that repeat in a row, as in text
with a period; with 400 bytes after the last they are a region. A text that occurs more than once is, in stretches
of bounded length, a region as well.

Regions of one anchor go to one shard; regions of equal bytes enter it once, as a region that stands for several;
regions of which no half of a string is there twice don't enter. Of each shard a Burrows-Wheeler transform is made,
and a breadth-first expansion of its intervals by backward extension derives the common prefixes of neighbouring
suffixes by increasing length. It stops at 400: what has no value by then shares 400 bytes or more, and that is all
that is asked.

An anchor whose distinct regions are too many for a shard (a common passage between texts that differ) is filed
more finely: by the bytes that all strings with the anchor at about the same offset have in common, at last by the
whole string, of which there is one. Every level goes through the same transform, so no string is judged otherwise.

Texts and regions are equal when their lengths and MD5 sums are.

Defined results: a null text is empty; shorter texts than 400 bytes lose nothing. Equal texts of 400 bytes or more
lose everything, rows that repeat a document too. An empty table gives an empty result. Only the id and what is
found come back. Very long texts are searched in stretches, so memory doesn't grow with their length alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import materialize, table

LENGTH = 400
GRAM = 32
#: Half of a string and of its anchor: what any string has from its anchor on, or up to the end of it.
HALF = (LENGTH + GRAM) // 2
#: How finely strings are filed, level by level: by the anchor alone, then also by its offset, cut into ranges so wide.
LEVELS = (None, 64, 8, 1)
#: Distinct regions of one file have about so many bytes at most, else they are filed anew on the next level.
FILE_BYTES = 500_000
#: Bytes of regions in a shard, about.
SHARD_BYTES = 250_000
#: Positions of a text that are searched for anchors at a time.
CHUNK = 1_000_000
#: Bytes of regions, or rows of files, in one record batch, about.
BATCH_BYTES, BATCH_ROWS = 8_000_000, 50_000
#: Occurrences of regions in the texts of one group, about.
LISTED = 1024
#: Up to this many rows of a few numbers are broadcast to the regions that they are of; more are joined by shuffling.
BROADCAST_ROWS = 200_000

_U = np.uint64
_AT = _U((1 << 24) - 1)


def _sums(data: np.ndarray) -> np.ndarray:
    S._grow(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(S._BYTES[data] * S._powers[: len(data)], out=out[1:])
    return out


def _between(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings from begin to end, by the sums of the powers of their text."""
    return S.mixed((sums[end] - sums[begin]) * S._inverses[begin] + (end - begin).astype(np.uint64))


def regions(text: bytes, width: int | None = None, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(file, first start, last start, how many files in a row), as arrays, stretch by stretch.

    width None: a string's file is its anchor. Else it's what all strings share that have the anchor at an offset in
    the same range of that width.
    """
    w = length - gram + 1
    for begin in range(0, max(0, len(text) - length + 1), CHUNK):
        data = np.frombuffer(text, np.uint8)[begin : begin + CHUNK + length - 1]
        sums = _sums(data)
        n, starts = len(data) - gram + 1, len(data) - length + 1
        grams = S.mixed((sums[gram:] - sums[:n]) * S._inverses[:n])
        key = (grams & ~_AT) | np.arange(n, dtype=np.uint64)
        blocks = np.full(-(-n // w) * w, ~_U(0))
        blocks[:n] = key
        blocks = blocks.reshape(-1, w)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & _AT).astype(np.int64)
        lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        hi, at = np.append(lo[1:], starts) - 1, at[lo]
        if width is None:
            file = grams[at]
        else:
            least, most = (at - hi) // width, (at - lo) // width
            many = most - least + 1
            of = np.repeat(np.arange(len(at)), many)
            # ranges of a region come by falling offset, so starts rise
            k = np.repeat(most, many) - (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many))
            at, near, far = at[of], k * width, np.minimum((k + 1) * width, w) - 1
            lo, hi = np.maximum(lo[of], at - far), np.minimum(hi[of], at - near)
            file = S.mixed(_between(sums, at - near, at - far + length) + k.astype(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        last = np.append(first[1:], len(file)) - 1
        yield file[first].view(np.int64), lo[first] + begin, hi[last] + begin, last - first + 1


def _sorted(value: np.ndarray, index: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both by value, ties in any order. Where value and index fit in one long, that is sorted itself, which is faster."""
    if bits + int(value.max(initial=0)).bit_length() < 64:
        both = np.sort((value << bits) | index)
        return both >> bits, both & ((1 << bits) - 1)
    by = np.argsort(value)
    return value[by], index[by]


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of regions that end before positions `ends` (separators); prefix doubling. Separators order by position.

    Only suffixes that aren't apart yet are sorted again.
    """
    n = len(data)
    bits = n.bit_length()
    left = np.repeat(ends, np.diff(np.concatenate(([-1], ends)))) - np.arange(n)  # bytes before the separator
    symbols = np.concatenate((data.astype(np.int64) + 1, np.zeros(8, np.int64)))
    symbols[ends] = 0
    step = 5
    key = symbols[:n].copy()
    for k in range(1, step):
        key *= 257
        key += np.where(left > k, symbols[k : k + n], 0)
    value, open_ = _sorted(key, np.arange(n), bits)
    rank, start = np.empty(n, np.int64), np.zeros(n, np.int64)
    while True:
        # open_: suffixes by value; start: the rank of the first of those that were alike before
        new = np.concatenate(([True], value[1:] != value[:-1]))
        place = np.arange(len(open_))
        group = np.concatenate(([True], start[1:] != start[:-1]))
        now = start + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank[open_] = now
        alone = new & np.append(new[1:], True)
        open_, now = open_[~alone], now[~alone]
        if not len(open_):
            break
        # those that end within `step` bytes are alike in all that is left, so their places in the data part them
        ahead = np.where(left[open_] >= step, rank[np.minimum(open_ + step, n - 1)], open_)
        value, open_ = _sorted((now << bits) | ahead, open_, bits)
        start = value >> bits
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def shared_prefixes(data: np.ndarray, ends: np.ndarray, often: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """For each position, whether its suffix shares `length` bytes with another suffix, both within their regions.

    often: whether a region stands for several of equal bytes; each of its suffixes is several then.

    Breadth-first over intervals of the transform: an interval of suffixes that begin with some string is extended
    backwards by each byte before it. The place after an extended interval that has no value yet gets the length of
    the string before extension, and only then the extended interval goes on.
    """
    n = len(data)
    order = suffix_array(data, ends)
    before = order - 1
    separator = np.zeros(n, bool)
    separator[ends] = True
    stop = separator[before] | (order == 0)  # no extension across regions
    symbol = np.where(stop, 256, data[before]).astype(np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    to = place[before]  # the row of the suffix that is one byte longer
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    # the empty string, extended by each byte and by each separator on its own
    r = len(ends)
    first_byte = data[order]
    lo = np.concatenate((np.arange(r), r + np.flatnonzero(np.concatenate(([True], first_byte[r:][1:] != first_byte[r:][:-1]))))) if n > r else np.arange(r)
    hi = np.append(lo[1:], n) - 1
    known[hi + 1] = True
    # rows in a row with the same byte before them extend together, so an interval is taken run by run
    change = np.concatenate(([True], symbol[1:] != symbol[:-1]))
    run = np.cumsum(change) - 1
    run_first = np.flatnonzero(change)
    run_last = np.append(run_first[1:], n) - 1
    for _ in range(1, length):
        if not len(lo):
            break
        # most intervals lie in one run and are extended by its byte alone
        single = run[lo] == run[hi]
        alone = np.flatnonzero(single & ~stop[lo])
        ahead = [(to[lo[alone]], to[hi[alone]])]
        rest = np.flatnonzero(~single)
        if len(rest):
            lo, hi = lo[rest], hi[rest]
            r0 = run[lo]
            many = run[hi] - r0 + 1
            which = np.repeat(np.arange(len(lo)), many)
            runs = np.repeat(r0 - np.cumsum(many) + many, many) + np.arange(len(which))
            first, last = np.maximum(run_first[runs], lo[which]), np.minimum(run_last[runs], hi[which])
            go = ~stop[first]
            which, first, last = which[go], first[go], last[go]
            key = which * 257 + symbol[first]
            by = np.argsort(key, kind="stable")
            key, first, last = key[by], first[by], last[by]
            edge = key[1:] != key[:-1]
            some = np.ones(min(1, len(key)), bool)
            ahead.append((to[first[np.concatenate((some, edge))]], to[last[np.concatenate((edge, some))]]))
        lo, hi = map(np.concatenate, zip(*ahead, strict=True)) if len(rest) else ahead[0]
        new = ~known[hi + 1]
        lo, hi = lo[new], hi[new]
        known[hi + 1] = True
    same = ~known  # same[k]: rows k - 1 and k share `length` bytes
    out = np.zeros(n, bool)
    out[order] = same[:n] | same[1:]
    if often is not None:
        sizes = np.diff(np.concatenate(([-1], ends)))
        out |= np.repeat(often, sizes) & (np.repeat(ends, sizes) - np.arange(n) >= length)
    return out


def _filed(rows: Iterator[tuple[bytes, tuple[np.ndarray, ...]]]) -> Iterator[pa.RecordBatch]:
    """Record batches of (key, regions), a row for each file of a text, however often the text has it: one with a period has few."""
    keys: list = []
    parts: list = []
    held = 0

    def batch() -> pa.RecordBatch:
        key = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(keys)), [len(p[0]) for p in parts]), pa.int32()), pa.array(keys, pa.binary()))
        file, lo, hi, many, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        ends = pa.array(np.append(0, np.cumsum(many)), pa.int32())
        at = (pa.ListArray.from_arrays(ends, pa.array(c, pa.int64())) for c in (lo, hi))
        return pa.record_batch([key.dictionary_decode(), pa.array(file, pa.int64()), *at, pa.array(times, pa.int64())], names=["key", "file", "lo", "hi", "times"])

    for key, (file, lo, hi, times) in rows:
        by = np.argsort(file, kind="stable")
        file = file[by]
        first = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        keys.append(key)
        parts.append((file[first], lo[by], hi[by], np.diff(np.append(first, len(file))), np.add.reduceat(times[by], first)))
        held += len(file)
        if held >= BATCH_ROWS:
            yield batch()
            keys, parts, held = [], [], 0
    if keys:
        yield batch()


def _file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Regions of whole texts by their anchors."""
    seen: set[bytes] = set()  # equal texts in one task are filed once

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                if key not in seen:
                    seen.add(key)
                    yield from ((key, found) for found in regions(t.as_py()))

    yield from _filed(rows())


def _finer(width: int):
    """Stretches of regions, filed more finely."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, t, found in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
                    t = t.as_py()
                    for x in found:
                        # the bytes are the same wherever in the text the stretch stands
                        begin = np.array(x["lo"])
                        for file, lo, hi, times in regions(t[x["lo"][0] : x["hi"][0] + LENGTH], width):
                            yield key, (np.tile(file, len(begin)), np.add.outer(begin, lo).ravel(), np.add.outer(begin, hi).ravel(), np.tile(times, len(begin)))

        yield from _filed(rows())

    return run


def _region_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of every region, once for all places of a text that have them. On the last level all strings of a region are one string, so that is what it has."""
    names = ["file", "key", "lo", "hi", "n", "same", "data"]
    places = pa.list_(pa.int64())
    kinds = (pa.int64(), pa.binary(), places, places, pa.int64(), pa.binary(), pa.binary())
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for key, t, found in zip(batch.column("key").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            t = t.as_py()
            for x in found:
                alike: dict[bytes, tuple[list[int], list[int]]] = {}
                for lo, hi in zip(x["lo"], x["hi"], strict=True):
                    at = alike.setdefault(t[lo : lo + LENGTH] if x["one"] else t[lo : hi + LENGTH], ([], []))
                    at[0].append(lo)
                    at[1].append(hi)
                for data, (los, his) in alike.items():
                    out.append((x["file"], key, los, his, x["n"] if x["one"] else x["n"] * len(los), hashlib.md5(data).digest(), data))
                    held += len(data) + 16 * len(los)
                    if held >= BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _alike(rows: list) -> list:
    """Those of rows (file, same, n, data), whole files, whose strings may repeat: for the others no transform is needed.

    A string has its anchor in its first half, with HALF bytes from there on, or in its second, with HALF bytes up to
    the anchor's end. So of regions that have neither in common with any place of their anchor, none repeats. Regions
    that occur more than once stay, as do those without the anchor itself, which are filed in another way.
    """
    lengths = np.array([len(x[3]) for x in rows])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(x[3] for x in rows), np.uint8)
    sums = _sums(data)
    of = np.repeat(np.arange(len(rows)), lengths)
    n = len(data) - GRAM + 1
    file = np.array([x[0] for x in rows], np.int64).view(np.uint64)
    at = np.flatnonzero(S.mixed((sums[GRAM:] - sums[:n]) * S._inverses[:n]) == file[of[:n]])
    at = at[at + GRAM <= ends[of[at]]]
    stay = np.array([x[2] > 1 for x in rows])
    stay |= np.bincount(of[at], minlength=len(rows)) == 0
    for begin, end in ((at, at + HALF), (at + GRAM - HALF, at + GRAM)):
        whole = (begin >= ends[of[at]] - lengths[of[at]]) & (end <= ends[of[at]])
        having = of[at][whole]
        # equal bytes have equal hashes, so hashes that meet by chance only let more through
        held = S.mixed(_between(sums, begin[whole], end[whole]) ^ file[having])
        _, which, many = np.unique(held, return_inverse=True, return_counts=True)
        stay[having[many[which] > 1]] = True
    return [x for x, keep in zip(rows, stay.tolist(), strict=True) if keep]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, same, n, data) come sorted by file; (file, same, runs) of the regions of which starts repeat."""

    def flush(rows: list) -> pa.RecordBatch:
        ends = np.cumsum([len(x[3]) + 1 for x in rows]) - 1
        shared = shared_prefixes(np.frombuffer(b"\0".join(x[3] for x in rows) + b"\0", np.uint8), ends, np.array([x[2] > 1 for x in rows]))
        # starts of one region in a row, as numbers of all: a region's last LENGTH - 1 bytes start none, so runs don't meet
        edge = np.flatnonzero(np.diff(np.concatenate(([0], shared.astype(np.int8), [0])))).reshape(-1, 2)
        k = np.searchsorted(ends, edge[:, 0])
        edge -= (ends[k] - [len(rows[x][3]) for x in k.tolist()])[:, None] if len(k) else 0
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, edge.size + 1, 2), pa.int32()), pa.array(edge.ravel(), pa.int64()))
        runs = pa.ListArray.from_arrays(pa.array(np.append(first, len(k)), pa.int32()), pairs)
        of = k[first].tolist()
        return pa.record_batch([pa.array([rows[x][0] for x in of], pa.int64()), pa.array([rows[x][1] for x in of], pa.binary()), runs], names=["file", "same", "runs"])

    rows: list[tuple] = []
    kept: list[tuple] = []
    size, held, last = 0, 0, None
    for batch in batches:
        for file, same, n, data in zip(*(batch.column(c).to_pylist() for c in ("file", "same", "n", "data")), strict=True):
            if file != last and size >= SHARD_BYTES:
                found = _alike(rows)
                kept += found
                held += sum(len(x[3]) + 1 for x in found)
                rows, size = [], 0
                if held >= SHARD_BYTES:
                    yield flush(kept)
                    kept, held = [], 0
            last = file
            rows.append((file, same, n, data))
            size += len(data) + 1
    if kept := kept + (_alike(rows) if rows else []):
        yield flush(kept)


_FILES = "key binary, file long, lo array<long>, hi array<long>, times long"
_REGIONS = "file long, key binary, lo array<long>, hi array<long>, n long, same binary, data binary"


def _with_texts(found: DataFrame, texts: DataFrame, few: bool = False) -> DataFrame:
    """(key, text, found): each text of (key, text) once, with its rows of found as an array of structs; few: found is of bounded size, and texts has each key once."""
    per_text = found.groupBy("key").agg(F.collect_list(F.struct(*(c for c in found.columns if c != "key"))).alias("found"))
    if few:
        per_text = F.broadcast(per_text)
    both = texts.select("key", "text").join(per_text, "key")
    return both if few else both.dropDuplicates(["key"])


def _shared(found: DataFrame) -> DataFrame:
    """The rows of found whose file has more than one; once, where a text was filed in several tasks."""
    found = materialize(found, "suffix-files")
    often = lambda df: df.groupBy("file").agg(F.sum("times").alias("n")).where("n > 1").select("file")
    # copies of a text in other tasks count at first; what is one text alone falls away below
    once = materialize(found.join(often(found), "file", "left_semi").dropDuplicates(["file", "key", "lo"]), "suffix-shared")
    return once.join(often(once), "file", "left_semi")


def _hot(rows: DataFrame) -> DataFrame | None:
    """(file) of files whose distinct regions are too many for a shard; None if there is none. They are few, so the regions needn't be shuffled to be told apart."""
    distinct = rows.groupBy("file", "same").agg(F.max(F.octet_length("data")).alias("size"))
    hot = materialize(distinct.groupBy("file").agg(F.sum("size").alias("size")).where(F.col("size") > FILE_BYTES).select("file"), "suffix-hot-files")
    many = hot.count()
    return None if not many else F.broadcast(hot) if many <= BROADCAST_ROWS else hot


def _places(rows: DataFrame) -> int:
    """How many regions the rows hold."""
    return rows.agg(F.sum(F.size("lo"))).first()[0] or 0


def _levels(rows: DataFrame) -> Iterator[DataFrame]:
    """Regions of files that fit a shard: those of rows, and finer ones for the others; base: where in the text lo and hi count from."""
    hot_files = _hot(rows)
    rows = rows.withColumn("base", F.lit(0).cast("long"))
    if hot_files is None:
        yield rows
        return
    yield rows.join(hot_files, "file", "left_anti")
    # a hot file's region is a text of its own from here on: its key is the text's and where it begins
    hot = rows.join(hot_files, "file", "left_semi")
    begin = F.unhex(F.lpad(F.hex("at.lo"), 16, "0"))
    hot = hot.select("key", F.col("data").alias("text"), F.explode(F.arrays_zip("lo", "hi")).alias("at"))
    texts = materialize(hot.select(F.concat("key", begin).alias("key"), "text", F.array(F.lit(0).cast("long")).alias("lo"), F.array(F.col("at.hi") - F.col("at.lo")).alias("hi")), "suffix-hot")
    few = lambda df: _places(df) <= BROADCAST_ROWS
    stretches, back = texts.select("key", "lo", "hi"), F.conv(F.hex(F.substring("key", 17, 8)), 16, 10).cast("long")
    for width in LEVELS[1:]:
        last = width == LEVELS[-1]
        shared = _shared(_with_texts(stretches, texts, few(stretches)).mapInArrow(_finer(width), _FILES))
        # on the last level a region is one string, as many times as it starts there
        shared = shared.select("key", "file", "lo", "hi", (F.col("times") if last else F.lit(1).cast("long")).alias("n"), F.lit(last).alias("one"))
        finer = materialize(_with_texts(shared, texts, few(shared)).mapInArrow(_region_rows, _REGIONS), "suffix-regions")
        whole = finer.withColumns({"base": back, "key": F.substring("key", 1, 16)})
        hot_files = None if last else _hot(finer)
        if hot_files is None:
            yield whole
            return
        yield whole.join(hot_files, "file", "left_anti")
        stretches = finer.join(hot_files, "file", "left_semi").select("key", "lo", "hi")


def repeated_spans(texts: DataFrame, parts: int) -> DataFrame:
    """(key, spans): merged byte spans, in order, of each text (key binary, text binary) that strings repeated in them cover.

    Rows with the same key, of 16 bytes, must have the same text.
    """
    long = texts.where(F.octet_length("text") >= LENGTH)
    shared = _shared(long.select("key", "text").mapInArrow(_file_rows, _FILES)).select("key", "file", "lo", "hi", F.lit(1).cast("long").alias("n"), F.lit(False).alias("one"))
    # texts that occur more than once are regions as they are, in stretches
    copies = long.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.max(F.octet_length("text")) - LENGTH).cast("long").alias("most")).where("n > 1")
    stretch = copies.withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), "most", F.lit(SHARD_BYTES).cast("long"))))
    stretch = stretch.select("key", F.xxhash64("key", "lo").alias("file"), F.array("lo").alias("lo"), F.array(F.least(F.col("lo") + SHARD_BYTES - 1, "most")).alias("hi"), "n", F.lit(False).alias("one"))
    rows = materialize(_with_texts(shared.unionByName(stretch), long).mapInArrow(_region_rows, _REGIONS), "suffix-regions")
    rows = reduce(DataFrame.unionByName, _levels(rows))
    distinct = rows.groupBy("file", "same").agg(F.sum("n").alias("n"), F.first("data").alias("data"))
    runs = distinct.repartition(parts, "file").sortWithinPartitions("file").mapInArrow(_repeats, "file long, same binary, runs array<array<long>>")
    runs = materialize(runs, "suffix-runs")
    # where a region occurs: texts are dealt to groups of about LISTED occurrences, and all that a group's texts have
    # of one region is one row, so a region that occurs in very many texts is a few rows and no occurrence is one
    where = rows.select("file", "same", "key", "base", "lo", "hi", F.octet_length("data").alias("size"))
    groups = max(1, _places(where) // LISTED)
    where = where.groupBy("file", "same", "size", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("of")).agg(F.collect_list(F.struct("key", "base", "lo", "hi")).alias("at"))
    found = where.join(runs, ["file", "same"]).select("of", "size", "runs", "at").repartition(parts, "of").sortWithinPartitions("of")
    return found.mapInArrow(_by_text, "key binary, spans array<array<long>>")


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (of, size, runs, at) come sorted by of; (key, merged spans) of each text, all of which is under one `of`."""

    def flush(held: dict[bytes, list]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(held, pa.binary()), pa.array([_merged(x) for x in held.values()], pa.list_(pa.list_(pa.int64())))], names=["key", "spans"])

    held: dict[bytes, list] = {}
    merge_at: dict[bytes, int] = {}
    last = None
    for batch in batches:
        for of, size, runs, at in zip(*(batch.column(c).to_pylist() for c in ("of", "size", "runs", "at")), strict=True):
            if of != last and held:
                yield flush(held)
                held, merge_at = {}, {}
            last = of
            for x in at:
                key, base = x["key"], x["base"]
                spans = held.setdefault(key, [])
                for lo, hi in zip(x["lo"], x["hi"], strict=True):
                    if hi - lo + LENGTH > size:  # one string that starts everywhere in the region
                        spans.append([base + lo, base + hi + LENGTH])
                    else:
                        spans.extend([base + lo + first, base + lo + end - 1 + LENGTH] for first, end in runs)
                if len(spans) > merge_at.get(key, LISTED):
                    held[key] = _merged(spans)
                    merge_at[key] = max(LISTED, 2 * len(held[key]))
    if held:
        yield flush(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for t, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            t = t.as_py() or b""
            merged = spans or []
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(t[at:s])
                at = e
            kept.update(t[at:])
            out.append((len(t), sum(e - s for s, e in merged), len(merged), kept.hexdigest(), merged))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<array<long>>) for every row of docs."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text")).withColumn("key", F.unhex(F.md5("text")))
    facts = materialize(repeated_spans(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))), "suffix-spans")
    return rows.join(facts, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the dedup of all documents."""
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
