"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, branches ranked by score, one conversation a path.

A node names its parent. Self-joins double the step upwards: from the parent to the parent's parent, then four, eight
and so on, until no node has an ancestor that far. The chosen leaves then walk up by these tables, longest step first, so
a path of n nodes comes to n rows after log2(n) joins of keys; only then are the texts joined to it. Siblings are ranked by
score (ties by node), and of a fork the best `branches` are followed; whole paths are ranked by the mean of their scores,
and of a tree the best `paths` are kept. Both are off unless asked for.

The template is a public one: `<|start_header_id|>role<|end_header_id|>`, two line feeds, the text, `<|eot_id|>`. Control
strings of this and other common templates that a role or a text holds are escaped: a backslash follows their first
character, and each backslash is doubled. So no control string is left inside a turn, and `unescape` is exact. The loss
mask is a list of byte ranges of the formatted conversation, one for the text of each assistant turn.

Defined results: a null or empty text is a turn with an empty text, a null role an empty role. A null tree id is a tree of
its own. A node without a parent, or whose parent isn't there, is a root. Of rows that share a node the smallest (parent,
role, text, score) counts. Nodes on a circle of parents, and below one, have no root and are on no path. A missing score is below
all others. In a conversation, rows of one turn follow each other by role and text, and rows without a turn come first; every
row counts, repeated ones too. A path is one row of the result, so a conversation, however formatted, must fit in a row
(2 GB); trees of any number of paths are never gathered. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize, running_totals, table

#: Control strings of common public templates. Each has two characters at least and begins with < or [.
CONTROLS = (
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)


@dataclass(frozen=True)
class Template:
    """What stands before the role, between role and text, and after the text; all three are or begin with control strings."""

    before: str = "<|start_header_id|>"
    between: str = "<|end_header_id|>\n\n"
    after: str = "<|eot_id|>"
    controls: tuple[str, ...] = CONTROLS

    def escape(self, text: Column) -> Column:
        """The text without a control string in it: a backslash after the first character of each, and backslashes doubled."""
        rests: dict[str, list[str]] = {}
        for c in self.controls:
            rests.setdefault(c[0], []).append(re.escape(c[1:]))
        starts = [f"{re.escape(first)}(?={'|'.join(rest)})" for first, rest in rests.items()]
        return F.regexp_replace(text, "|".join(["\\\\", *starts]), "$0\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, "(?s)\\\\(.)", "$1")

    def turn(self, role: Column, text: Column) -> tuple[Column, Column]:
        """(what precedes the text, the text and what follows it), formatted."""
        return F.concat(F.lit(self.before), self.escape(role), F.lit(self.between)), F.concat(self.escape(text), F.lit(self.after))

    def parse(self, formatted: Column) -> Column:
        """array of (role, text): what was formatted."""
        pieces = F.split(formatted, re.escape(self.after), -1)
        pieces = F.slice(pieces, 1, F.size(pieces) - 1)
        halves = F.transform(pieces, lambda p: F.split(p, re.escape(self.between), 2))
        return F.transform(halves, lambda h: F.struct(self.unescape(F.substring(F.get(h, F.lit(0)), len(self.before) + 1, 2**31 - 1)).alias("role"), self.unescape(F.get(h, F.lit(1))).alias("text")))


TEMPLATE = Template()
#: Turns with this role are learned.
LEARNED = "assistant"
#: Turns of a conversation whose rows are ordered at a time.
TURNS = 64


def conversation_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(tree, node, parent, role, text, score) of conversations given as rows by turn: each row replies to the one before."""
    rows = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    # rows are counted in stretches of turns, so a long conversation is sorted in many tasks
    rows = rows.withColumn("_stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-(2**53))) / TURNS)).withColumn("_one", F.lit(1).cast("long"))
    placed = running_totals(rows, ["tree"], "_stretch", [F.col("turn").asc_nulls_first(), "role", "text"], "_one", "node")
    return placed.select("tree", "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


def _on(tree: str, node: str):
    return F.col("tree").eqNullSafe(F.col(tree)) & (F.col("up") == F.col(node))


def _links(nodes: DataFrame, branches: int | None) -> DataFrame:
    """(tree, node, up): nodes and their parents that are there; up is null for roots. Forks keep their best branches."""
    held = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    links = nodes.select("tree", "node", "score", F.col("parent").alias("up")).join(held, _on("_t", "_n"), "left").select("tree", "node", "score", F.col("_n").alias("up"))
    if branches is not None:
        best = F.row_number().over(Window.partitionBy("tree", "up").orderBy(F.col("score").desc_nulls_last(), "node"))
        forks = links.where(F.col("up").isNotNull()).withColumn("_best", best).where(F.col("_best") <= branches).drop("_best")
        links = links.where(F.col("up").isNull()).unionByName(forks)
    return links.drop("score")


def _steps(links: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up), each written: up lies 1, 2, 4 ... nodes above node. They end where no node has one so far up."""
    steps, last = [], None
    now = links.where(F.col("up").isNotNull())
    while True:
        now = materialize(now, "reply-steps")
        many = now.count()
        # without circles every round leaves fewer; what never ends is on a circle or below one
        if not many or many == last:
            discard(now)
            return steps
        steps.append(now)
        last = many
        there = now.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        now = now.join(there, _on("_t", "_n")).select("tree", "node", F.col("_up").alias("up"))


def reply_paths(nodes: DataFrame, branches: int | None = None, paths: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, leaf, up, node): the nodes of each chosen path, `up` steps above its leaf; and the written tables it reads.

    nodes: (tree, node, parent, score), without repeated nodes.
    """
    links = materialize(_links(nodes, branches), "reply-links")
    steps = _steps(links)
    # what pruning cut off, and circles, never reach a root
    inner = links.where(F.col("up").isNotNull()).select(F.col("tree").alias("_t"), F.col("up").alias("_n")).distinct()
    leaves = links.select("tree", F.col("node").alias("leaf"), F.col("node").alias("up")).join(inner, _on("_t", "_n"), "left_anti")
    walk = leaves.select("tree", "leaf", "up", F.lit(0).cast("long").alias("height"))
    for k in reversed(range(len(steps))):
        step = steps[k].select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        walk = walk.join(step, _on("_t", "_n"), "left")
        own, higher = F.struct("up", "height"), F.struct(F.col("_up").alias("up"), (F.col("height") + 2**k).alias("height"))
        walk = walk.select("tree", "leaf", F.inline(F.when(F.col("_up").isNull(), F.array(own)).otherwise(F.array(own, higher))))
    walk = walk.withColumnRenamed("up", "node")
    # a path counts if it has a root: cut ones and those below a circle have none
    roots = links.where(F.col("up").isNull()).select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    walk = materialize(walk.join(roots, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")), "left").select("tree", "leaf", "node", "height", F.col("_n").isNotNull().alias("root")), "reply-walk")
    made = [links, *steps, walk]
    kept = walk.groupBy(F.col("tree").alias("_t"), F.col("leaf").alias("_l")).agg(F.max("root").alias("_whole")).where("_whole")
    if paths is not None:
        scores = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "score")
        scored = walk.join(scores, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n"))).groupBy("tree", "leaf").agg(F.max("root").alias("_whole"), F.avg("score").alias("_mean")).where("_whole")
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("_mean").desc_nulls_last(), "leaf"))
        kept = scored.withColumn("_rank", rank).where(F.col("_rank") <= paths).select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"))
    return walk.join(kept, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("leaf") == F.col("_l")), "left_semi").drop("root"), made


def format_trees(trees: DataFrame, branches: int | None = None, paths: int | None = None, template: Template = TEMPLATE, learned: str = LEARNED) -> DataFrame:
    """(tree, leaf, n_turns, formatted, loss): one row for each chosen path of trees (tree, node, parent, role, text, score).

    loss: array of (begin, end), byte offsets in the UTF-8 of `formatted`, ascending.
    """
    one = trees.where(F.col("node").isNotNull()).groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("_row")).select("tree", "node", "_row.*")
    nodes = materialize(one, "reply-nodes")
    found, made = reply_paths(nodes.select("tree", "node", "parent", "score"), branches, paths)
    head, body = template.turn(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), head.alias("head"), body.alias("body"), (F.col("role") == learned).alias("learned"))
    turns = found.join(turns, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("node") == F.col("_n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.col("height").desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = lambda c: F.octet_length(c).cast("long")
    begin = F.coalesce(F.sum(size("head") + size("body")).over(before), F.lit(0)) + size("head")
    turns = turns.select("tree", "leaf", F.struct((-F.col("height")).alias("at"), F.concat("head", "body").alias("turn"), F.when(F.col("learned"), F.struct(begin.alias("begin"), (begin + size("body") - len(template.after.encode())).alias("end"))).alias("loss")).alias("turn"))
    whole = turns.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    out = whole.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"), F.filter("turns.loss", lambda x: x.isNotNull()).alias("loss"))
    out = materialize(out, "conversations")
    discard(nodes, *made)
    return out


def learned_text(formatted: Column, loss: Column, template: Template = TEMPLATE) -> Column:
    """All text under the mask, read from the formatted conversation and unescaped."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda x: template.unescape(F.substring(data, (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int")).cast("string"))), "")


#: The conversation that says what the template must escape.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Contract columns of all conversations and the planted one, read back from what was formatted."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PLANTED, rows.schema))
    out = format_trees(conversation_trees(rows))
    told = F.array_join(F.transform(TEMPLATE.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select(F.col("tree").alias("conv_id"), F.size(TEMPLATE.parse(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def _sql() -> str:
    def size(c):
        """Length of the escaped value: one more character for each backslash and each control string."""
        quoted = [f"'{x}'" for x in ("\\", *CONTROLS)]
        return f"length({c}) + " + " + ".join(f"(length({c}) - length(replace({c}, {q}, ''))) // length({q})" for q in quoted)

    marks = len(TEMPLATE.before + TEMPLATE.between + TEMPLATE.after)
    planted = ", ".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in PLANTED)
    return f"""
    with rows as (select conv_id, turn, coalesce(role, '') role, role = '{LEARNED}' learned, coalesce(text, '') text from (select conv_id, turn, role, text from conversations union all values {planted})),
    sized as (select *, {size("role")} + {size("text")} + {marks} chars from rows)
    select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) turns_sha256,
      coalesce(sum(length(text)) filter (learned), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (learned), '')) loss_sha256, sum(chars)::bigint formatted_chars
    from sized group by conv_id
    """


OP11_SQL = _sql()

__all__ = ["OP11_SQL", "Template", "conversation_trees", "format_trees", "learned_text", "op11_chat_formatting", "reply_paths"]
