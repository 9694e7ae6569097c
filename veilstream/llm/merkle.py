"""Merkle manifest of a dataset: leaves, subroots, root and every leaf's proof, by a butterfly exchange.

A leaf is the digest of a row's fields. Leaves of a group stand in order; every `arity` consecutive nodes become their
digest until one remains, the group's subroot; the subroots, ordered by group, become the root in the same way.

Only digests are ever moved. Ranks come from one range partitioning: the place within a partition, plus the counts of
the partitions before. Aligned blocks of arity ** levels leaves are then the partitions of the exchange: each climbs to
its own subtree root, and in every round the blocks at the same offset of `radix` neighbouring subtrees (an aligned
group) swap roots. Each of them hashes the common ancestors for itself, so after the last round every block holds all
proofs above it, and no pass goes down again. Where the last subtree of a group is not full, its blocks stand in for the
missing ones, each for as many as another, so no block receives more than radix - 1 roots.

Defined results: null fields count as `-`, an empty text as `0:`. Rows without an id come first in their group, and ties
of id are ordered by leaf, so repeated rows are leaves of their own. Null is a group of its own, before all others. A
very long text is hashed where it stands and never moved. An empty table gives an empty result. Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, table

#: Nodes of a run; levels within a block; levels of a round, so a round joins arity ** ROUND_LEVELS subtrees.
ARITY, BLOCK_LEVELS, ROUND_LEVELS = 2, 10, 4
#: Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: `-` for null, else the number of UTF-8 bytes, `:` and the value."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def _parents(nodes: Column, arity: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * arity + 1, F.lit(arity))), 256))


def ranked(df: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df with rank (long, from 0) and n (rows of the group), and the table that this reads. One range partitioning, whatever the group's size."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftrightunsigned("_at", 33)), "merkle-order")
    counts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_many"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_many").over(before), F.lit(0))).withColumn("n", F.sum("_many").over(Window.partitionBy("_g")))
    out = placed.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_g", "_p", "_first", "_many", "_before"), placed


def up(nodes: list[str], arity: int) -> list[str]:
    return [hashlib.sha256("".join(nodes[k : k + arity]).encode()).hexdigest() for k in range(0, len(nodes), arity)]


def height(n: int, arity: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def climb(nodes: list[str], n: int, arity: int, levels: int) -> list[list[str]]:
    """The levels of a block, its leaves first, its root last."""
    out = [nodes]
    for _ in range(min(levels, height(n, arity))):
        out.append(up(out[-1], arity))
    return out


def blocks(leaves: DataFrame, group: str, carried: list[str], arity: int, levels: int) -> DataFrame:
    """(group, block, n, nodes, root): the leaves of each aligned block in order, with the columns carried, and its root."""
    size = arity**levels
    packed = leaves.groupBy(group, "n", F.floor(F.col("rank") / size).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("rank", "leaf", *carried))).alias("nodes"))

    def roots(batches):
        for batch in batches:
            found = [climb([x["leaf"] for x in nodes], n, arity, levels)[-1][0] for nodes, n in zip(batch.column("nodes").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(roots, f"{schema}, root string")


def exchange(roots: DataFrame, group: str, arity: int, levels: int, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """(group, block, n, root, above): the group's subroot and, level by level, the siblings above each block.

    roots: (group, block, n, root), n the number of leaves of the group. A round is one shuffle of digests.
    """
    radix = arity**round_levels
    state = roots.withColumn("above", F.array().cast("array<array<string>>")).withColumn("m", F.ceil(F.col("n") / arity**levels).cast("long"))
    most = roots.agg(F.max("n")).first()[0] or 0
    span, level = 1, levels
    while span * arity**levels < most:
        subtree = F.floor(F.col("block") / span).cast("long")
        sends = state.withColumn("_over", F.floor(subtree / radix).cast("long")).withColumn("_digit", (subtree % radix).cast("int")).withColumn("_offset", F.col("block") % span)
        there = F.least(F.lit(span), F.col("m") - subtree * span)
        alone = F.col("m") - F.col("_over") * span * radix <= span
        to = F.when(alone, F.array("_offset")).otherwise(F.sequence(F.col("_offset"), F.lit(span - 1).cast("long"), there))
        own = F.struct("block", "above", F.col("_digit").alias("digit"))
        sends = sends.withColumn("_to", F.explode(to)).withColumn("_own", F.when(F.col("_to") == F.col("_offset"), own))
        met = sends.groupBy(group, "n", "m", "_over", "_to").agg(F.array_sort(F.collect_list(F.struct("_digit", "root"))).alias("_got"), F.collect_list("_own").alias("_here"))
        met = met.where(F.size("_here") > 0).withColumn("_nodes0", F.col("_got.root"))
        for k in range(round_levels):
            # this level has more than one node in the whole group
            more = F.col("n") > arity ** (level + k)
            met = met.withColumn(f"_nodes{k + 1}", F.when(more, _parents(F.col(f"_nodes{k}"), arity)).otherwise(F.col(f"_nodes{k}")))

        def beside(digit, k):
            at = F.floor(digit / arity**k).cast("int")
            run = F.slice(F.col(f"_nodes{k}"), F.floor(at / arity).cast("int") * arity + 1, F.lit(arity))
            return F.filter(run, lambda _, i: i != at % arity)

        heard = met.select(group, "n", "m", F.get(f"_nodes{round_levels}", F.lit(0)).alias("root"), *(f"_nodes{k}" for k in range(round_levels)), F.explode("_here").alias("_own"))
        now = heard.select(group, F.col("_own.block").alias("block"), "n", "m", "root", F.concat("_own.above", F.array(*(beside(F.col("_own.digit"), k) for k in range(round_levels)))).alias("above"))
        now = materialize(now.select(state.columns), "merkle-round")
        if span > 1:
            discard(state)
        state, span, level = now, span * radix, level + round_levels
    return state.drop("m")


def fold(node: str, index: int, path: list[list[str]], arity: int) -> str:
    """The root that a leaf at this index and its siblings, level by level, come to."""
    for siblings in path:
        at, index = index % arity, index // arity
        node = hashlib.sha256("".join([*siblings[:at], node, *siblings[at:]]).encode()).hexdigest()
    return node


def manifest(rows: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: tuple = FIELDS, suspect: dict[str, Column] | None = None, arity: int = ARITY, levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """(id, group, rank, leaf, subroot, root, proof_sha256, folded_root, verified) for every row.

    suspect: other values of fields; folded_root is the root that the leaf made of them comes to with the proof, and
    verified says if that is the root. Without it the rows' own leaves are folded.
    """
    own = {f: F.col(f"`{f}`") for f in fields}
    found = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group}`").alias("group"), leaf(list(own.values())).alias("leaf"), (leaf(list((own | suspect).values())) if suspect else F.lit(None).cast("string")).alias("other"))
    found = materialize(found.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "merkle-leaves")
    # the groups' trees
    ordered, placed = ranked(found, "group", ["id", "leaf"])
    packed = materialize(blocks(ordered, "group", ["id", "other"], arity, levels), "merkle-blocks")
    discard(found, placed)
    above = materialize(exchange(packed.select("group", "block", "n", "root"), "group", arity, levels, round_levels).withColumnRenamed("root", "subroot"), "merkle-above")
    # the tree over their subroots
    ordered, placed = ranked(above.where("block = 0").select(F.lit(0).alias("all"), F.col("group").alias("of"), F.col("subroot").alias("leaf")), "all", ["of"])
    top = materialize(blocks(ordered, "all", ["of"], arity, levels), "merkle-tops")
    over = exchange(top.select("all", "block", "n", "root"), "all", arity, levels, round_levels).select(F.col("block").alias("_block"), F.col("root").alias("top"), F.col("above").alias("top_above"))
    groups = top.drop("root").join(over, F.col("block") == F.col("_block"))

    def siblings(inner, over, n):
        """For each leaf of a block its siblings, level by level up to the root."""
        rest = over[: height(n, arity) - len(inner) + 1]
        for at in range(len(inner[0])):
            path = []
            for nodes in inner[:-1]:
                low = at // arity * arity
                path.append(nodes[low:at] + nodes[at + 1 : low + arity])
                at //= arity
            yield path + rest

    def paths(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                inner = climb([x["leaf"] for x in r["nodes"]], r["n"], arity, levels)
                out += [{"of": x["of"], "top": r["top"], "top_rank": x["rank"], "top_path": path} for x, path in zip(r["nodes"], siblings(inner, r["top_above"], r["n"]))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("of", batch.schema.field("nodes").type.value_type.field("of").type), ("top", pa.string()), ("top_rank", pa.int64()), ("top_path", pa.list_(pa.list_(pa.string())))]))

    def proofs(batches):
        for batch in batches:
            types = [batch.schema.field("nodes").type.value_type.field("id").type, batch.schema.field("group").type, pa.int64(), *[pa.string()] * 5, pa.bool_()]
            for r in batch.to_pylist():
                inner, out = climb([x["leaf"] for x in r["nodes"]], r["n"], arity, levels), []
                ends = "".join(s for path in r["top_path"] for s in path)
                for x, path in zip(r["nodes"], siblings(inner, r["above"], r["n"])):
                    proof = hashlib.sha256(("".join(s for level in path for s in level) + ends).encode()).hexdigest()
                    root = fold(fold(x["other"] or x["leaf"], x["rank"], path, arity), r["top_rank"], r["top_path"], arity)
                    out.append((x["id"], r["group"], x["rank"], x["leaf"], r["subroot"], r["top"], proof, root, root == r["top"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "group", "rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    id_type, group_type = found.schema["id"].dataType.simpleString(), found.schema["group"].dataType.simpleString()
    groups = groups.mapInArrow(paths, f"of {group_type}, top string, top_rank long, top_path array<array<string>>")
    whole = packed.drop("root").join(above.select(F.col("group").alias("_g"), F.col("block").alias("_b"), "subroot", "above"), F.col("group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    whole = whole.join(groups, F.col("group").eqNullSafe(F.col("of"))).drop("of")
    out = materialize(whole.mapInArrow(proofs, f"id {id_type}, group {group_type}, rank long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), "merkle-manifest")
    discard(packed, above, placed, top)
    return out


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Contract columns of all documents; where 7 divides crc32 of the decimal id, the suspect row has n_chars + 1."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(table(spark, sf_dir, "documents"), suspect={"n_chars": tampered})
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: The same in SQL: all levels of all trees by recursion, then proofs and folds leaf by leaf.
OP12_SQL = """
with recursive
crc_table as (select list(c order by i) tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) t(i))),
fields as (
  select doc_id, lang, n_chars, doc_id::varchar d,
    case when doc_id is null then '-' else strlen(doc_id::varchar)::varchar || ':' || doc_id::varchar end || case when source is null then '-' else strlen(source)::varchar || ':' || source end || case when lang is null then '-' else strlen(lang)::varchar || ':' || lang end head,
    case when text is null then '-' else strlen(text)::varchar || ':' || text end tail from documents),
crcs as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(d, ''), lambda c: ord(c)::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) crc from fields, crc_table),
leaves as (
  select doc_id, lang, sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar end || tail) leaf,
    sha256(head || case when n_chars is null then '-' else strlen((n_chars + (crc % 7 = 0)::int)::varchar)::varchar || ':' || (n_chars + (crc % 7 = 0)::int)::varchar end || tail) other from crcs),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lang) n from leaves),
nodes as (
  select lang, 0 l, i, n, leaf h from placed
  union all
  select a.lang, a.l + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) from nodes a left join nodes b on a.lang is not distinct from b.lang and a.i + 1 = b.i where a.n > 1 and a.i % 2 = 0),
subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 i, count(*) over () n from nodes where n = 1),
tops as (
  select 0 l, i, n, h from subroots
  union all
  select a.l + 1, a.i // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) from tops a left join tops b on a.i + 1 = b.i where a.n > 1 and a.i % 2 = 0),
steps as (
  select p.lang, p.i, x.l, x.i % 2 side, y.h from placed p join nodes x on p.lang is not distinct from x.lang and x.i = p.i >> x.l and x.n > 1
    left join nodes y on x.lang is not distinct from y.lang and x.l = y.l and y.i = xor(x.i, 1)
  union all
  select p.lang, p.i, 1000 + x.l, x.i % 2, y.h from placed p join subroots s on p.lang is not distinct from s.lang join tops x on x.i = s.i >> x.l and x.n > 1
    left join tops y on x.l = y.l and y.i = xor(x.i, 1)),
paths as (select lang, i, list(struct_pack(side := side, h := coalesce(h, '')) order by l) path from steps group by all),
joined as (select p.*, coalesce(path, []) path from placed p left join paths q on p.lang is not distinct from q.lang and p.i = q.i),
folded as (
  select doc_id, lang, i, leaf, path, 1 k, other h from joined
  union all
  select doc_id, lang, i, leaf, path, k + 1, sha256(case when path[k].side = 1 then path[k].h || h else h || path[k].h end) from folded where k <= len(path))
select f.doc_id, f.leaf, s.h subroot, (select h from tops where n = 1) root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda x: x.h)), 'string_agg', '')) proof_sha256, f.h folded_root, f.h = (select h from tops where n = 1) verified
from folded f join subroots s on f.lang is not distinct from s.lang where k > len(path)
"""

__all__ = ["OP12_SQL", "exchange", "fold", "height", "leaf", "manifest", "op12_merkle_manifest", "ranked"]
