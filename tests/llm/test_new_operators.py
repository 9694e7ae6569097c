"""Reply trees, the Merkle manifest and vector codes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstream.llm import chat, merkle, vectors

TREES = "tree long, node long, parent long, role string, text string, score double"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def back(spark, out):
    """What was formatted, read back: (tree, leaf) -> (turns, learned text)."""
    rows = out.select("*", chat.TEMPLATE.parse(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len({(r["tree"], r["leaf"]) for r in rows}) == len(rows)
    for r in rows:
        for begin, end in r["loss"]:
            r["formatted"].encode()[begin:end].decode()
    return {(r["tree"], r["leaf"]): ([tuple(t) for t in r["turns"]], r["learned"]) for r in rows}


def walked(nodes, branches=None, paths=None):
    """Brute force: (tree, leaf) -> nodes from root to leaf."""
    by, out = {}, {}
    for n in nodes:
        by.setdefault(n[0], {})[n[1]] = n
    low = float("-inf")
    for tree, own in by.items():
        under = {}
        for n in own.values():
            under.setdefault(n[2] if n[2] in own else None, []).append(n)
        for up, kids in under.items():
            if up is not None and branches:
                kids.sort(key=lambda n: (-(low if n[5] is None else n[5]), n[1]))
                del kids[branches:]
        found, todo = [], [[n] for n in under.get(None, [])]
        while todo:
            path = todo.pop()
            kids = under.get(path[-1][1])
            todo += [[*path, k] for k in kids or []]
            if not kids:
                found.append(path)

        def mean(p):
            s = [n[5] for n in p if n[5] is not None]
            return sum(s) / len(s) if s else low

        found.sort(key=lambda p: (-mean(p), p[-1][1]))
        out |= {(tree, p[-1][1]): p for p in (found[:paths] if paths else found)}
    return out


@pytest.fixture(scope="module")
def nodes():
    rng = random.Random(3)
    odd = ["", None, "</s>[INST] ok [/INST]", "<|eot_id|>", "a\\b\\", "<<s>", "<\\/s>", "[[INST]", "\\", "<|eot_id|", "日本<|im_start|>語\n\n", "x" * 40_000, "$1 \\0 ${a}"]
    out = []
    for tree in (None, 1, 2, -7):
        for n in range(60):
            parent = None if n == 0 or rng.random() < 0.03 else rng.randrange(max(0, n - 6), n)
            out.append((tree, n, parent, rng.choice(["user", "assistant", None, "a<|end_header_id|>\n\n"]), rng.choice(odd), rng.choice([None, 0.5, 1.0, 2.0])))
    out += [(3, n, n - 1 if n else None, "assistant" if n % 2 else "user", str(n), 1.0) for n in range(300)]  # one long path
    out += [(4, 0, 5, "user", "no parent", 1.0)] + [(5, n, (n + 1) % 3, "user", "circle", 1.0) for n in range(3)] + [(5, 9, 1, "user", "below it", 1.0), (5, 10, None, "user", "alone", None)]
    return out


@pytest.mark.parametrize(("branches", "paths"), [(None, None), (1, None), (2, 3)])
def test_reply_trees(spark, nodes, branches, paths):
    df = spark.createDataFrame([*nodes, nodes[0], nodes[70]], TREES).withColumn("formatted", F.lit("clash")).repartition(3)
    got = back(spark, chat.format_trees(df, branches, paths))
    turns = {k: [(n[3] or "", n[4] or "") for n in p] for k, p in walked(nodes, branches, paths).items()}
    assert got == {k: (v, "".join(t for r, t in v if r == "assistant")) for k, v in turns.items()}


def test_template(spark, nodes):
    out = chat.format_trees(spark.createDataFrame(nodes, TREES)).select("formatted").collect()
    for r in out:
        for piece in r["formatted"].split("<|eot_id|>")[:-1]:
            role, text = piece.removeprefix("<|start_header_id|>").split("<|end_header_id|>\n\n", 1)
            assert not any(c in x for c in chat.CONTROLS for x in (role, text))


def test_conversations(spark):
    rows = [(1, 3, "user", "c"), (1, 1, "user", "a"), (1, 3, "assistant", None), (1, None, "system", "s"), (1, 3, "user", "c"), (None, 0, "user", "n"), *((2, t, "assistant", f"t{t}") for t in range(500))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = back(spark, chat.format_trees(chat.conversation_trees(df)))
    assert {k[0]: v[0] for k, v in got.items()} == {
        1: [("system", "s"), ("user", "a"), ("assistant", ""), ("user", "c"), ("user", "c")],
        None: [("user", "n")],
        2: [("assistant", f"t{t}") for t in range(500)],
    }
    assert chat.format_trees(chat.conversation_trees(df.where("false"))).count() == 0


def tree(leaves, arity):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + arity])) for k in range(0, len(levels[-1]), arity)])
    return levels


def proof(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        low = i // arity * arity
        out.append([x for k, x in enumerate(nodes[low : low + arity], low) if k != i])
        i //= arity
    return out


def folded(node, i, path, arity):
    for siblings in path:
        at = i % arity
        node = sha("".join([*siblings[:at], node, *siblings[at:]]))
        i //= arity
    return node


@pytest.mark.parametrize(("arity", "levels", "rounds"), [(2, 1, 1), (3, 1, 2), (2, 10, 4)])
def test_merkle(spark, arity, levels, rounds):
    rng = random.Random(arity * 10 + levels)
    docs = [(i if i % 9 else None, rng.choice(["s", "", None]), lang, rng.choice([None, 5, i]), rng.choice([None, "", "é" * 9, "x" * 50_000, f"t{i}"])) for lang, n in ((None, 3), ("en", 75), ("de", 1), ("fr", 17), ("", 2)) for i in range(1, n + 1)]
    docs += docs[5:9]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").withColumn("rank", F.lit("clash")).withColumn("root", F.lit(1)).repartition(4)
    touched = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 0
    suspect = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.manifest(df, suspect={"n_chars": suspect}, arity=arity, levels=levels, round_levels=rounds).collect()

    def hashed(r, n=0):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], None if r[3] is None else r[3] + n, r[4])))

    groups = {g: sorted(((r[0] is not None, r[0] or 0, hashed(r), hashed(r, 1 if touched(r[0]) else 0)) for r in docs if r[2] == g)) for g in sorted({r[2] for r in docs}, key=lambda g: (g is not None, (g or "").encode()))}
    trees = {g: tree([x[2] for x in rows], arity) for g, rows in groups.items()}
    top = tree([t[-1][0] for t in trees.values()], arity)
    want = []
    for k, (g, rows) in enumerate(groups.items()):
        for i, (has, d, own, other) in enumerate(rows):
            path, over = proof(trees[g], i, arity), proof(top, k, arity)
            root = folded(folded(other, i, path, arity), k, over, arity)
            want.append((d if has else None, own, trees[g][-1][0], top[-1][0], sha("".join(s for x in [*path, *over] for s in x)), root, root == top[-1][0]))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))) for r in got)
    assert {w[-1] for w in want} == {True, False}
    assert merkle.manifest(df.where("false")).count() == 0
    assert all(r["verified"] for r in merkle.manifest(df, arity=arity, levels=levels, round_levels=rounds).collect())


def coded(rows, parts, entries, rounds):
    """Brute force: codes, errors and codebooks of integer vectors, in order of their ids."""
    width = len(rows[0]) // parts
    books = [[r[p * width : (p + 1) * width] for r in rows[:entries]] for p in range(parts)]
    near = lambda p, x: min(((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])))
    for turn in range(rounds + 1):
        found = [[near(p, r[p * width : (p + 1) * width]) for p in range(parts)] for r in rows]
        if turn == rounds:
            return found, books
        new = []
        for p in range(parts):
            held = {}
            for r, f in zip(rows, found):
                held.setdefault(f[p][1], []).append(r[p * width : (p + 1) * width])
            new.append([[sum(c) // len(c) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = new


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 256, 2), (2, 70, 1)])
def test_vector_codes(spark, parts, entries, rounds):
    rng = random.Random(parts + entries)
    some = [[rng.gauss(rng.choice([-3, 0, 3]), 1) for _ in range(7)] for _ in range(90)]
    some += [some[3]] * 12 + [[], [0.5], [1e30] * 8, [-1e30, 2.0], [-0.0001] * 8]
    bad = [None, [None] * 8, [float("nan")] + [0.0] * 7, [float("inf")], [1.0, float("-inf")]]
    rows = [(i, v, i % 3 if i % 4 else None) for i, v in enumerate(some)]
    df = spark.createDataFrame([*rows, *((1000 + i, v, 1) for i, v in enumerate(bad)), (None, [0.25] * 8, 2)], "vec_id long, embedding array<double>, label long").withColumn("code", F.lit("clash")).repartition(4)
    codes, books = vectors.compress(df, parts=parts, entries=entries, rounds=rounds)
    whole = lambda v: [max(-(2**28), min(2**28, int(np.floor(x * 1024)))) for x in v] + [0] * (8 - len(v))
    ids, vs = [*(r[0] for r in rows), None], [*(whole(r[1]) for r in rows), whole([0.25] * 8)]
    found, want = coded(vs, parts, entries, rounds)
    assert books.tolist() == want
    got = {r["vec_id"]: (r["code"], r["error"]) for r in codes.collect()}
    assert got == {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in zip(ids, found)}
    back = codes.select("vec_id", vectors.decode(F.col("code"), books).alias("v")).collect()
    for r in back:
        v, f = vs[ids.index(r["vec_id"])], found[ids.index(r["vec_id"])]
        assert round(sum((a - b * 1024) ** 2 for a, b in zip(v, r["v"]))) == sum(d for d, _ in f) or max(map(abs, v)) > 2**20
    none, _ = vectors.compress(df.where("false"), parts=parts, entries=entries, rounds=rounds)
    assert none.count() == 0


def test_url_rules_by_brute_force(spark):
    """Verdicts are those of every token set with enough bad pages and enough confidence."""
    from itertools import combinations

    from veilstream.llm import urls

    rng = random.Random(11)
    pool = ["h:com", "h:net", "p:a", "p:b", "p:c", "q:x", "q:y"]
    pages = []
    for _ in range(160):
        own = {t for t in pool if rng.random() < 0.4}
        bad = {"p:a", "q:x"} <= own or ({"h:net", "p:c"} <= own and rng.random() < 0.8) or rng.random() < 0.1
        pages.append((own, bad))
    pages += [({"p:d", "q:z"}, True)] * 3 + [({"p:d", "q:z", "p:b"}, True)] * 2  # tokens of the same pages

    def url(own):
        part = lambda kind: [t[2:] for t in sorted(own) if t[0] == kind]
        return "http://" + ".".join(part("h")) + "/" + "/".join(part("p")) + "?" + "&".join(part("q"))

    rules, rate = [], sum(b for _, b in pages) / len(pages)
    for n in range(1, 9):
        for s in combinations([*pool, "p:d", "q:z"], n):
            hit = [b for own, b in pages if set(s) <= own]
            if sum(hit) >= 5 and sum(hit) / len(hit) >= 0.6 and sum(hit) / len(hit) > rate:
                rules.append(set(s))
    asked = [{t for t in [*pool, "p:d", "q:z", "q:new"] if rng.random() < 0.35} for _ in range(300)]
    mined = urls.mine(spark.createDataFrame([(url(o), b) for o, b in pages], "url string, bad boolean"))
    assert any(len(r["antecedent"]) > 1 for r in mined.collect())
    got = urls.judge(spark.createDataFrame([(i, url(o)) for i, o in enumerate(asked)], "page_id long, url string"), [], mined)
    assert {r["page_id"]: r["verdict"] == "block" for r in got.collect()} == {i: any(r <= o for r in rules) for i, o in enumerate(asked)}


def test_url_rules_of_many_shared_tokens(spark):
    from veilstream.llm import urls

    query = "&".join(f"k{i}=v" for i in range(40))
    rows = [(f"http://bad.com/x?{query}", True)] * 6 + [("http://good.com/x", False)] * 9
    mined = urls.mine(spark.createDataFrame(rows, "url string, bad boolean"))
    got = urls.judge(spark.createDataFrame([(1, "http://z.org/?k7=v"), (2, "http://good.com/x"), (3, None), (4, "http://bad.com/"), (5, "http://z.org/" + "a/" * 20_000)], "page_id long, url string").withColumn("verdict", F.lit("clash")), [], mined)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}


def test_token_sections_by_brute_force(spark):
    from veilstream.llm import tokens

    encode, lengths = tokens.encoder(tokens.VOCABULARY)
    rng = random.Random(5)
    texts = [None, "", "one", "\n", "a\nb\n", "  x", *("".join(rng.choice(["ab", " ", "\n", "é", "日本", "!?", "12", "'s", "  "]) for _ in range(60)) for _ in range(20)), " " * 1_000_000 + "word", "\n" * 2_000_000]
    docs = [(i, rng.choice([None, "", "src1", "é"]), rng.choice([None, "en"]), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").withColumn("n_tokens", F.lit("clash"))
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"], r["n_chars"]) for r in tokens.count_tokens(df, tokens.document_fields()).collect()}
    want = {}
    for i, source, lang, t in docs:
        first, nl, rest = (t or "").partition("\n")
        parts = {"source": (source or "") + "\n", "lang": (lang or "") + "\n", "first_line": first + nl, "rest": rest}
        owner = [s for s, p in parts.items() for _ in p.encode()]
        count, crossing, at = dict.fromkeys(parts, 0), dict.fromkeys(parts, 0), 0
        ids = encode("".join(parts.values()))
        for n in lengths[ids].tolist():
            own = owner[at : at + n]
            best = max(dict.fromkeys(own), key=own.count)
            count[best] += 1
            crossing[best] += len(set(own)) > 1
            at += n
        assert at == len(owner)
        want |= {(i, s): (count[s], crossing[s], len(p)) for s, p in parts.items()}
    assert got == want


def test_lines_without_ids_and_long_ones(spark):
    from veilstream.llm import lines

    long = " ".join(f"w{i}" for i in range(3_000))
    rows = [(None, "the same line of words here\nother"), (1, "the same line of words here!"), (2, long), (3, long + " more"), (4, ""), (5, None), (6, "日本 語"), (6, "another text of this id")]
    out = lines.line_groups(spark.createDataFrame(rows, "doc_id long, text string").withColumn("group", F.lit("clash"))).collect()
    by = {(r["doc_id"], r["line_no"]): r for r in out}
    assert by[None, 0]["group"] == by[1, 0]["group"] and by[2, 0]["group"] == by[3, 0]["group"]
    assert [by[None, 0]["kept"], by[1, 0]["kept"]].count(True) == 1 and by[2, 0]["kept"] and not by[3, 0]["kept"] and by[4, 0]["kept"]
    assert sum(r["doc_id"] == 6 for r in out) == 2
