"""Each operator against brute force on a small fixture with nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilstream.llm import decontamination, edits, jaccard, licenses, lines, mixing, quality, sharding, suffixes, tokens, urls

SPACE_WORD, WORD = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, source string, lang string, size string, shard string, component_id string, n string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def _texts():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéè") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage, item = prose(200), prose(80), prose(14)
    out = [None, "", " \n\t ", "one", "One", "a b c", "a b  c", base, base, base.upper(), base.replace(" ", "\n", 3)]
    for k in (1, 3, 5, 8, 20):
        ws = base.split()
        for _ in range(k):
            ws[rng.randrange(len(ws))] = "new" + str(rng.randrange(10**6))
        out.append(" ".join(ws))
    out += [prose(60) + "\n" + passage + "\n" + prose(60) for _ in range(3)] + [passage]
    out += ["spam spam eggs " * 90, "word " * 300, "a#b$ | " * 60, prose(3000), prose(49), prose(30) + " " + item + " " + prose(30), item, item[: len(item) // 2]]
    out += ["Released under the MIT License. " + prose(55), "Licensed under CC BY-NC 4.0", "apache license apache license", "same line here again\nSame line, here again!\nother words on this line", "日本語 テキスト x"]
    out += [base, None]  # rows 0 and 7 once more, under other ids
    return out, item


TEXTS, ITEM = _texts()


@pytest.fixture(scope="module")
def rows():
    own = [(i, t, f"s{i % 4}" if i % 5 else None, "en", "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    return [*own, own[7]]  # and one row repeated as it is


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected, cols):
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, expected))


def test_quality(docs, rows, empty):
    def of(t):
        w = SPACE_WORD.findall(t or "")
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        many, hit, seen, dup = Counter(three), set(), set(), 0
        for i, x in enumerate(three):
            if many[x] > 1:
                hit |= {i, i + 1, i + 2}
        for line in (t or "").split("\n"):
            if SPACE_WORD.search(line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)

    out = quality.judge(docs)
    same(out, [(r[0], *of(r[1])) for r in rows], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"])
    kept = [r["doc_id"] for r in out.where("kept").collect()]
    assert sorted(kept) == sorted(r["doc_id"] for r in quality.keep_documents(docs).collect())
    for order in (quality.RULES, quality.RULES[::-1]):
        assert sorted(r["doc_id"] for r in quality.keep_documents(docs, rules=order).collect()) == sorted(kept)
    assert quality.judge(empty).count() == 0
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}
    assert [r.name for r in quality.order_rules(docs)] == [r.name for r in quality.order_rules(docs.repartition(5))]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, quality.judge(docs).collect()))
    # a rule behind one that rejects isn't evaluated: this one would fail
    fails = quality.Rule("fails", lambda f: F.raise_error(F.lit("evaluated")).cast("boolean"))
    every = quality.Rule("every", lambda f: F.lit(True) & (f("n_words") >= 0))
    assert quality.keep_documents(docs, rules=[every, fails]).count() == 0
    assert quality.judge(docs, rules=[every, fails]).where("kept").count() == 0


def _classes(rows):
    sets = {}
    for r in rows:
        w = SPACE_WORD.findall(low(r[1]))
        k = min(5, len(w))
        sets[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


@pytest.mark.parametrize("frequent", [256, 2])
def test_jaccard(docs, rows, empty, frequent, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "COUNT_LEAST", 1 if frequent == 2 else 8)
    sets, label = _classes(rows)
    same(jaccard.near_classes(docs), [(r[0], len(sets[r[0]]), label[r[0]]) for r in rows], ["doc_id", "n_shingles", "component_id"])
    if frequent == 256:
        assert jaccard.near_classes(empty).count() == 0
        kept = jaccard.drop_near_duplicates(docs)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in label if label[i] == i) and kept.columns == docs.columns


def test_drop_near_duplicates(spark):
    """Rows without id, one id with two texts, repeated rows, and columns with the names that joins like to use."""
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, prose(1)), (None, prose(2)), (3, prose(1) + " end"), (4, prose(3)), (4, prose(4)), (4, prose(4)), (5, None), (6, ""), (6, ""), (7, prose(4) + " end"), (None, prose(5))]
    docs = spark.createDataFrame([(*r, k, 1, 1) for k, r in enumerate(rows)], "doc_id long, text string, of_id int, of_key int, set int")
    kept = jaccard.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == sorted([(0, prose(2)), (0, prose(5)), (3, prose(1) + " end"), (4, prose(3)), (4, prose(4)), (5, ""), (6, "")])


def test_jaccard_signatures():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(4, 200))
        a = np.unique(rng.integers(0, 2**63, x, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[rng.random(len(a)) > 0.12], rng.integers(0, 2**63, int(rng.integers(0, x // 8 + 1)), dtype=np.uint64))))
        both = len(np.intersect1d(a, b))
        assert jaccard.most_shared(jaccard.sketch(a), jaccard.sketch(b)) >= both
        frequent = np.sort(rng.permutation(np.concatenate((a, b)))[: int(rng.integers(0, x))])
        if jaccard.linked(len(a), len(b), both) and len(a) != both:
            assert len(np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent))), (len(a), len(b), both)


def _repeated(rows):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    many = Counter(t[i : i + 400] for _, t in raw for i in range(len(t) - 399))
    for i, t in raw:
        gone = np.zeros(len(t) + 1, np.int8)
        for s in range(len(t) - 399):
            if many[t[s : s + 400]] > 1:
                gone[s : s + 400] = 1
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        yield i, len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()


SPAN_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("file_bytes", [1_000_000, 3000, 1])  # 1: every file goes down to the last level
def test_suffixes(docs, rows, empty, file_bytes, monkeypatch):
    monkeypatch.setattr(suffixes, "FILE_BYTES", file_bytes)
    same(suffixes.dedup(docs), _repeated(rows), SPAN_COLUMNS)
    if file_bytes == 3000:
        assert suffixes.dedup(empty).count() == 0


def test_suffixes_passage_and_periods(spark, monkeypatch):
    """A passage between texts that differ, in more of them than a file holds; texts with a period; no ids."""
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(700)
    texts = [noise(rng.randrange(60)) + passage + noise(rng.randrange(500)) for _ in range(40)]
    texts += ["a" * 900, "b" + "a" * 650 + "c", "xyz" * 300, "q" + "xyz" * 170 + noise(90), noise(399), passage[:399], passage[5:405], passage[:350] + "!" + passage[350:]]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)]
    for file_bytes in (1_000_000, 5000, 1):
        monkeypatch.setattr(suffixes, "FILE_BYTES", file_bytes)
        same(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")), _repeated(rows), SPAN_COLUMNS)


def test_suffixes_a_text_has_each_file_once(spark, monkeypatch):
    """Texts with a long period between texts that differ, filed down to the last level: a row for a text's file, not for each of its places."""
    texts = [f"{i:05d}" * (3 + i) + "Is on. " * 250 + f"{i * 7:04d}" * 20 for i in range(8)]
    rows, counts = list(enumerate(texts)), []

    def counted(df, label, write=suffixes.materialize):
        out = write(df, label)
        if label in ("suffix-files", "suffix-regions"):
            counts.append(out.count())
        return out

    monkeypatch.setattr(suffixes, "FILE_BYTES", 1)
    monkeypatch.setattr(suffixes, "materialize", counted)
    same(suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")), _repeated(rows), SPAN_COLUMNS)
    assert len(counts) == 8 and max(counts) < 1000


def test_suffixes_transform_takes_what_may_repeat(monkeypatch):
    """Regions of one anchor that are alike, alike for half of a string, alike at the anchor only, or there twice; one with its anchor in two places."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    anchor = noise(suffixes.GRAM)
    tail, head, mid = noise(400), noise(400), noise(300)
    texts = [noise(390) + anchor + tail, noise(390) + anchor + tail[:380] + "!", head + anchor + noise(390), head[1:] + anchor + noise(390), noise(390) + anchor + tail[:190] + noise(200)]
    texts += [noise(390) + anchor + mid + anchor + noise(90), noise(390) + anchor + noise(390)] + [noise(380) + anchor + noise(380) for _ in range(20)]
    parts = [t.encode() for t in texts]
    file = int(suffixes.S.mixed(suffixes._sums(np.frombuffer(anchor.encode(), np.uint8))[-1:]).view(np.int64)[0])
    times = [2 if k == 6 else 1 for k in range(len(parts))]
    taken = []

    def counted(data, ends, *more, run=suffixes.shared_prefixes):
        taken.append(len(data))
        return run(data, ends, *more)

    monkeypatch.setattr(suffixes, "shared_prefixes", counted)
    batch = pa.record_batch([pa.array([file] * len(parts)), pa.array([hashlib.md5(t).digest() for t in parts]), pa.array(times), pa.array(parts)], names=["file", "same", "n", "data"])
    found = {r["same"]: r["runs"] for out in suffixes._repeats(iter([batch])) for r in out.to_pylist()}
    many = Counter(t[i : i + 400] for t, n in zip(parts, times, strict=True) for i in range(len(t) - 399) for _ in range(n))
    want = {}
    for t in parts:
        edge = np.flatnonzero(np.diff(np.concatenate(([0], [many[t[i : i + 400]] > 1 for i in range(len(t) - 399)], [0])).astype(int))).reshape(-1, 2).tolist()
        if edge:
            want[hashlib.md5(t).digest()] = edge
    assert found == want and len(want) == 5
    assert sum(taken) <= sum(len(t) + 1 for t in parts[:7])


def test_suffixes_hot_files_are_told_apart_without_a_shuffle(spark, monkeypatch):
    """However large the other regions are."""
    monkeypatch.setattr(suffixes, "FILE_BYTES", 3000)
    rows = [(k % 5 // 4, bytes(16), [k], [k], 1, bytes([k]) * 16, bytes([k]) * 401) for k in range(1, 21)]
    rows = spark.createDataFrame(rows, suffixes._REGIONS)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = next(suffixes._levels(rows))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and {r["file"] for r in left.collect()} == {1}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_licenses(docs, rows, empty):
    out = {(r["doc_id"]): r for r in licenses.scan(docs).collect()}
    for r in rows:
        w = WORD.findall(low(r[1]))
        starts = sorted(i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert (out[r[0]]["n_words"], out[r[0]]["starts"]) == (len(w), starts)
    assert licenses.scan(empty).count() == 0
    a = licenses.Automaton("x", "this <<any:2>> is <<opt>>very<<end>> free")
    m = lambda s: a.match(licenses.words(s.encode()), 0)
    assert [m("This is free"), m("this big red work is free"), m("this a b is very free now"), m("this is not free"), m("is free")] == [3, -1, 6, -1, -1]


def test_decontamination(spark, docs, rows, empty):
    items = [(1, ITEM), (2, ITEM.upper()), (3, ""), (4, None), (5, "日本語 テキスト"), (6, TEXTS[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    expected = []
    for r in rows:
        w, hit, found = WORD.findall(low(r[1])), set(), set()
        for p, owners in windows.items():
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    found |= owners
        expected.append((r[0], len(w), len(hit), sorted(map(str, found))))
    for size in (2_000_000, 20):
        out = decontamination.find(docs, bench, block_words=size)
        out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))
        same(out, expected, ["doc_id", "n_words", "n_hit", "item_ids"])
    assert decontamination.find(empty, bench).count() == 0 and decontamination.find(docs, bench.limit(0)).where("size(spans) > 0").count() == 0
    clean = decontamination.drop_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(e[0] for e in expected if not e[2]) and clean.columns == docs.columns


def test_mixing(docs, rows, empty):
    out = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(SPACE_WORD.findall(r[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight, target, left = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(sizes.values())
    open_ = set(names)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
    target |= {s: level * weight[s] for s in open_}
    assert len(out) == len(rows)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
    biggest = max(r["size"] for r in out)
    for s in names:
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - target[s]) <= biggest / 2 + 1
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs.repartition(2)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(docs).columns == docs.columns


def test_sharding(docs, rows, empty):
    out = sharding.shard(docs, shards=4).collect()
    per = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and set(per) <= set(range(4)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(per[s]))
    import zlib

    raw = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(r["size"] == len(raw[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(raw[r["doc_id"]]) for r in out)
    assert len({r["shard"] for r in out if raw[r["doc_id"]] == TEXTS[7].encode()}) == 1
    assert sharding.shard(empty).count() == 0


def _cut(out):
    """Groups of several rows: how many shards each is in."""
    per = {}
    for r in out:
        if r["group"] is not None:
            per.setdefault(r["group"], []).append(r["shard"])
    return {g: (len(s), len(set(s))) for g, s in per.items() if len(s) > 1}


def test_sharding_whole_groups(spark):
    """Two-copy groups with few free rows stay whole, and a group of a third of all rows is in 6 of 16 shards."""
    pairs = spark.range(3600).selectExpr("id doc_id", "concat('t', id div 2) text").union(spark.range(3600, 4000).selectExpr("id", "cast(null as string)"))
    third = spark.range(4000).selectExpr("id doc_id", "case when id < 1334 then 'x' when id < 3600 then concat('t', id div 2) end text")
    for df in (pairs, third):
        out = sharding.shard(df).collect()
        assert len({r["doc_id"] for r in out}) == len(out) == 4000 and set(Counter(r["shard"] for r in out).values()) == {250}
        cut = [(n, in_) for n, in_ in _cut(out).values() if in_ > 1]
        assert cut == ([] if df is pairs else [(1334, 6)])


def test_lines(spark, docs, empty):
    out = lines.line_groups(docs).collect()
    assert len(out) == sum((t or "").count("\n") + 1 for t in TEXTS if t is not None)
    by = {(r["doc_id"], r["line_no"]): r for r in out}
    i = next(k for k, t in enumerate(TEXTS) if t and t.startswith("same line"))
    assert by[i, 0]["kept"] and not by[i, 1]["kept"] and by[i, 2]["kept"] and by[i, 0]["group"] == by[i, 1]["group"]
    assert lines.line_groups(empty).count() == 0
    assert [lines.blocks_for(n) for n in (2, 10**6, 10**10)] == sorted(lines.blocks_for(n) for n in (2, 10**6, 10**10))


def _edit_similarity(x, y):
    row = np.arange(len(y) + 1)
    codes, steps = np.array([ord(c) for c in y]), np.arange(len(y) + 1)
    for i, c in enumerate(x, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))))
        row = np.minimum.accumulate(new - steps) + steps
    return 1 - row[-1] / max(len(x), len(y), 1)


def _fuzzy_pairs(seed, each):
    """(kind, line, changed line) with an edit similarity of 0.75 at least: typos, an inserted word, a changed number, several words."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    out = []
    for n in (3, 6, 12, 20, 50):
        for kind in ("typo", "insert", "number", "words"):
            while sum(k == (kind, n) for k, _, _ in out) < each:
                w = [word() for _ in range(n)]
                w[rng.randrange(n)] = str(rng.randrange(10**4, 10**6))
                v = list(w)
                if kind == "insert":
                    v.insert(rng.randrange(n + 1), word())
                elif kind == "number":
                    v[next(i for i, x in enumerate(v) if x.isdigit())] = str(rng.randrange(10**4, 10**6))
                else:
                    for i in rng.sample(range(n), 1 if kind == "typo" else max(1, n // 6)):
                        j = rng.randrange(len(v[i]))
                        v[i] = v[i][:j] + rng.choice(letters) + v[i][j + 1 :] if kind == "typo" else word()
                if w != v and _edit_similarity(" ".join(w), " ".join(v)) >= 0.75:
                    out.append(((kind, n), " ".join(w), " ".join(v)))
    return out


def test_lines_leave_no_keys_behind(spark, docs, monkeypatch):
    """Tables of keys are the largest: each is deleted as soon as the next one is made."""
    written, there = [], []

    def noted(df, label, write=lines.materialize):
        out = write(df, label)
        written.append((label, out.written_at.removeprefix("file:")))
        there.append({name for name, at in written if os.path.isdir("/" + at.lstrip("/"))} & {"line-members", "line-named", "line-apart"})
        return out

    monkeypatch.setattr(lines, "materialize", noted)
    lines.line_groups(docs).count()
    assert {"line-members", "line-named", "line-apart"} <= {name for name, _ in written}
    assert max(map(len, there)) == 2 and not there[-1]


def test_fuzzy_lines(spark):
    pairs = _fuzzy_pairs(5, 10)
    texts = [x for _, a, b in pairs for x in (a, b)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in lines.line_groups(df).collect()}
    found = Counter(kind for k, (kind, _, _) in enumerate(pairs) if group[2 * k] == group[2 * k + 1])
    assert sum(found.values()) >= 0.95 * len(pairs), found
    assert all(found[kind, n] == 10 for kind in ("typo", "insert", "number") for n in (12, 20, 50)), found
    assert len({group[2 * k] for k in range(len(pairs))}) == len(pairs)  # nothing else is linked


def test_hashes_of_lines_need_no_shuffle(spark):
    """Majorities of bits and least hashes of runs are those of Spark's own functions, found without an exchange."""
    rng = random.Random(3)
    texts = ["a", "中 b", "the " * 300 + "end"] + [" ".join(rng.choice(["the", "of", "élan", "x1", "日本", "zz"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, norm string")
    out = lines.simhashes(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    rows = df.selectExpr("h", "length(norm) as chars", "split(norm, ' ', -1) as w").selectExpr("h", "chars", "w", "posexplode(w) as (i, x)")
    rows = rows.selectExpr("h", "chars", "xxhash64(x) as x", "xxhash64(x, get(w, i + 1), get(w, i + 2), get(w, i + 3)) as run")
    bits = [f"case when sum(shiftrightunsigned(x, {b}) & 1) * 2 > count(1) then {1 << b}L else 0L end" for b in range(62)]
    want = rows.groupBy("h").agg(F.expr("count(1) as n"), F.max("chars").alias("chars"), F.expr(f"{' | '.join(bits)} as sim"), *(F.expr(f"min(hash(run, {j})) as r{j}") for j in range(10)))
    assert out.dtypes == want.dtypes and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_bound_of_edit_distance():
    """No pair within a quarter of its length falls away, whatever its characters and lengths; pairs far beyond do."""
    rng, texts, apart = random.Random(8), [], []
    for k in range(400):
        x = "".join(rng.choice("abcdeé日😀 "[: rng.choice([2, 4, 9])]) for _ in range(rng.choice([1, 3, 20, 63, 64, 65, 130, 600])))
        y = list(x)
        for _ in range(int(len(x) * rng.choice([0, 0.1, 0.2, 0.27, 0.4]))):
            i, kind = rng.randrange(len(y) + 1), rng.random()
            y[i : i + (kind < 0.7)] = rng.choice("abé日 ") if kind > 0.3 else ""
        texts += [x, "".join(y)]
    many = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (150, 150, 5000, 5200) for _ in range(9)]
    texts += many + [many[-1].replace("a", "zz")]
    a = np.arange(0, 800, 2, dtype=np.int32)
    unlike = np.array([(800 + i, 800 + j) for i in range(36) for j in range(i) if (i < 18) == (j < 18)], np.int32)
    a, b = np.concatenate((a, unlike[:, 0], [835, 0])), np.concatenate((a + 1, unlike[:, 1], [836, 0]))
    may = edits.within(edits.encoded(pa.array(texts)), a.astype(np.int32), b.astype(np.int32))
    sure = edits.surely(edits.encoded(pa.array(texts)), a, b)
    for k in range(400):
        if _edit_similarity(texts[2 * k], texts[2 * k + 1]) >= 0.75:
            apart.append(bool(may[k]))
        else:
            assert not sure[k]
    assert not sure[400:-2].any() and sure[-1] and sure[:400].sum() > 0.9 * len(apart)
    # characters that share a class make nothing certain
    odd = ["".join(chr(0x4E00 + i + k * 40) for i in range(200)) for k in range(3)]
    assert not edits.surely(edits.encoded(pa.array(odd)), np.array([0, 1]), np.array([1, 2])).any()
    assert len(apart) > 200 and all(apart) and may[-2:].all()
    assert not may[400:-2].any()


@pytest.mark.parametrize("block", [1024, 7])
def test_unlike_lines_of_a_key_are_not_verified(spark, monkeypatch, block):
    """Lines that share words and no more: hardly a pair reaches edit similarity, and the groups are those of brute force."""
    rng, written = random.Random(9), {}

    def noted(df, label, write=lines.materialize):
        written[label] = write(df, label)
        return written[label]

    monkeypatch.setattr(lines, "materialize", noted)
    monkeypatch.setattr(lines, "BLOCK_LINES", block, raising=False)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    texts = [" ".join([word(), word(), "one", "of", "the", "same", word()]) for _ in range(80)]
    texts += [t[:-1] + "0" for t in texts[::4]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {r["doc_id"]: r["group"] for r in lines.line_groups(df).collect()}
    like = {frozenset((i, j)) for i in range(100) for j in range(i) if _edit_similarity(texts[i], texts[j]) >= 0.75}
    assert like == {frozenset((4 * k, 80 + k)) for k in range(20)}
    assert {frozenset((i, j)) for i in range(100) for j in range(i) if group[i] == group[j]} == like
    assert written["line-across"].count() <= len(like)


def test_tokens(spark, docs, empty):
    assert tokens.attribute(np.array([2, 5, 9]), np.array([0, 3, 3, 9]))[0].tolist() == [1, 0, 2]
    assert [x.tolist() for x in tokens.attribute(np.array([4]), np.array([0, 2, 4]))] == [[1, 0], [1, 0]]
    out = tokens.count_tokens(docs, {"head": F.lit("ab"), "text": F.col("text")})
    encode, _ = tokens.encoder(tokens.VOCABULARY)
    expected = Counter()
    for r in docs.collect():
        expected[r["doc_id"]] += len(encode("ab" + (r["text"] or "")))
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == expected and tokens.count_tokens(empty, {"text": F.col("text")}).count() == 0


def test_urls(spark):
    pages = [(0, "http://a.com/x"), (1, "https://www.example.com/en/1?q=1"), (2, "http://m.example.com/en/"), (3, "ftp://x.net/fr/#a"), (4, None), (5, "no scheme"), (6, "http://EXAMPLE.com?x"), (7, "http://net"), (7, "http://net"), (8, "http://bad.example.org/spam/1")]
    pages += [(100 + i, f"http://bad.example.org/spam/{i}") for i in range(9)] + [(200 + i, f"http://good.example.org/ham/{i}") for i in range(9)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(9)] + [(200 + i, 1, 0) for i in range(9)] + [(999, None, None)], "doc_id long, quality int, toxic int")
    out = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, urls.RULES, urls.mine(urls.label_pages(df, labels))).collect() if r["page_id"] < 100]
    assert sorted(out) == [
        (0, "a.com", "/x", "com/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "m.example.com", "/en/", "example.com/en/", "block"), (3, "x.net", "/fr/", "net/fr/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "example.com", "", None, "allow"), (7, "net", "", None, "allow"), (7, "net", "", None, "allow"), (8, "bad.example.org", "/spam/1", None, "block"),
    ]
    assert urls.judge(df.limit(0), urls.RULES, urls.mine(urls.label_pages(df.limit(0), labels))).count() == 0


def test_urls_support_at_every_size(spark):
    """Five bad pages make a rule among 20 labelled pages and among 5,000; four don't."""
    for others in (20, 5000):
        bad = [(f"http://bad.org/spam/{i}", True) for i in range(5)] + [(f"http://few.org/x/{i}", True) for i in range(4)]
        df = spark.createDataFrame(bad + [(f"http://good{i % 7}.com/ham/{i}", False) for i in range(others)], "url string, bad boolean")
        rules = {tuple(r["antecedent"]): (r["confidence"], r["support"]) for r in urls.mine(df).collect()}
        assert rules["p:spam",] == (1.0, 5 / (others + 9)) and rules["h:bad", "p:spam"][0] == 1.0 and not any("h:few" in k for k in rules)
