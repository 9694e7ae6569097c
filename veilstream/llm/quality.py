"""Quality rules: a short-circuit cascade whose order comes from costs and selectivities estimated on a sample.

Every rule is a Column over the text and its words, so the whole cascade is one CASE expression: a row that an early
rule rejects never pays for a later one. No row moves between machines. A rule's cost is what its features take for
the sample's texts: a weight for each character, word and line, given with the feature. So neither the order nor
any column depends on a clock, and reruns agree.

Defined results: a null or empty text has no words, and the base rule `few_words` rejects it. Repeated rows and
ties of cost are judged alike (ties go by the rule's name). Very long texts are judged whole. An empty table gives
an empty result, and then the rules keep the order in which they are listed. Other columns of the input pass through
`keep_documents` unchanged; `judge` returns its own columns only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOLS_PER_WORD = 0.2
MAX_DUP_LINE_SHARE = 0.8
MAX_BULLET_SHARE = 0.9
MIN_LETTER_WORD_SHARE = 0.6
MIN_LINES = 5
MEAN_WORD_CHARS = (2.0, 14.0)
#: Rows of the sample on which costs and selectivities are estimated, about.
SAMPLE_ROWS = 2000


def word_chars(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_letter_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.rlike(w, F.lit("\\p{L}")))).cast("long")


def _worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))


def n_dup_lines(text: Column) -> Column:
    return let(_worded_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_bullet_lines(text: Column) -> Column:
    return F.size(F.filter(_worded_lines(text), lambda x: F.rlike(x, F.lit("^[ \\t]*[-*•‣·]")))).cast("long")


def n_lines(text: Column) -> Column:
    return F.size(_worded_lines(text)).cast("long")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the array of words holds twice or more.

    Windows become hashes packed above their position in one long; after a primitive sort equal windows are
    neighbours, so the whole is O(n log n) for a text of any length. Neighbours count if their words are equal.
    """

    def positions(w: Column, packed: Column, bits: Column, mask: Column) -> Column:
        at = lambda i: F.get(packed, i).bitwiseAND(mask).cast("int")
        equal = lambda p, q: (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))
        alike = lambda i: F.call_function("shiftright", F.get(packed, i).bitwiseXOR(F.get(packed, i + 1)), bits) == 0
        twins = F.filter(F.sequence(F.lit(0), F.size(packed) - 2), lambda i: alike(i) & equal(at(i), at(i + 1)))
        both = F.flatten(F.transform(twins, lambda i: F.array(F.get(packed, i), F.get(packed, i + 1))))
        return F.sort_array(F.array_distinct(F.transform(both, lambda x: x.bitwiseAND(mask))))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def packed(w: Column, bits: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))))

    def of(w: Column) -> Column:
        # bits and mask are bound once a text, not once a window
        return let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, lambda mask: let(packed(w, bits), lambda x: let(positions(w, x, bits, mask), covered))))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(of(w)))


@dataclass(frozen=True)
class Feature:
    """of(text, words) gives its Column; cost: of a character, a word and a line, in nanoseconds, about."""

    of: Callable[[Column, Column], Column]
    cost: tuple[float, float, float]


#: What the features cost was measured once; only the order of the rules rests on it.
FEATURES = {
    "n_words": Feature(lambda t, w: F.size(w).cast("long"), (0.0, 1.0, 0.0)),
    "word_chars": Feature(lambda t, w: word_chars(w), (0.0, 60.0, 0.0)),
    "n_symbols": Feature(lambda t, w: n_symbols(t), (8.0, 0.0, 0.0)),
    "n_letter_words": Feature(lambda t, w: n_letter_words(w), (0.0, 120.0, 0.0)),
    "n_lines": Feature(lambda t, w: n_lines(t), (2.0, 0.0, 200.0)),
    "n_dup_lines": Feature(lambda t, w: n_dup_lines(t), (4.0, 0.0, 300.0)),
    "n_bullet_lines": Feature(lambda t, w: n_bullet_lines(t), (3.0, 0.0, 400.0)),
    "n_repeat_words": Feature(lambda t, w: repeat_words(w), (0.0, 900.0, 0.0)),
}


@dataclass(frozen=True)
class Rule:
    """rejects(feature) is true for a document to reject; feature(name) gives a feature's Column. A null counts as false."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False

    def features(self) -> list[str]:
        found: list[str] = []
        self.rejects(lambda name: found.append(name) or F.lit(0))
        return list(dict.fromkeys(found))


RULES = [
    Rule("few_words", lambda f: f("n_words") < MIN_WORDS, base=True),
    Rule("repeats", lambda f: f("n_repeat_words") * 100 > f("n_words") * MAX_REPEAT_PERCENT, base=True),
    Rule("symbols", lambda f: f("n_symbols") > f("n_words") * MAX_SYMBOLS_PER_WORD),
    Rule("word_length", lambda f: ~(f("word_chars") / F.greatest(f("n_words"), F.lit(1))).between(*MEAN_WORD_CHARS)),
    Rule("letters", lambda f: f("n_letter_words") < f("n_words") * MIN_LETTER_WORD_SHARE),
    Rule("dup_lines", lambda f: (f("n_lines") >= MIN_LINES) & (f("n_dup_lines") > f("n_lines") * MAX_DUP_LINE_SHARE)),
    Rule("bullets", lambda f: (f("n_lines") >= MIN_LINES) & (f("n_bullet_lines") > f("n_lines") * MAX_BULLET_SHARE)),
]


def order_rules(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample, most first. Only the order depends on it, never a verdict.

    The sample is of about `sample_rows` rows, those whose text has a small hash. One job finds what each rule
    rejects, and the characters, words and lines that its features read.
    """
    rules = rules or RULES
    rows = docs.count()
    if not rows:
        return list(rules)
    t = text_of(text)
    some = docs.select(t.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(min(1.0, sample_rows / rows) * (1 << 20)))
    some = some.select("t", words_of(F.col("t")).alias("w"))
    of = lambda name: FEATURES[name].of(F.col("t"), F.col("w"))
    sizes = [F.sum(x) for x in (F.length("t"), F.size("w"), F.size(F.split("t", "\n", -1)))]
    seen, *found = some.agg(F.count(F.lit(1)), *sizes, *(F.count_if(rule.rejects(of)) for rule in rules)).first()
    if not seen:
        return list(rules)
    cost = lambda rule: sum(c * x for name in rule.features() for c, x in zip(FEATURES[name].cost, found[:3], strict=True)) + 1.0
    rated = [(-n / cost(rule), rule.name, rule) for rule, n in zip(rules, found[3:], strict=True)]
    return [rule for *_, rule in sorted(rated, key=lambda x: x[:2])]


def cascade(rules: list[Rule], feature: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or null; later rules aren't evaluated."""
    out = None
    for rule in rules:
        out = F.when(rule.rejects(feature), rule.name) if out is None else out.when(rule.rejects(feature), rule.name)
    return out if out is not None else F.lit(None).cast("string")


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base features, base_failed, rejected_by (first rule in the cascade's order) and kept.

    Base features are results, so every row has them; what other rules need is evaluated inside the cascade only.
    """
    rules = rules or order_rules(docs, text=text)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text).alias("_text"))
    rows = rows.withColumn("_words", words_of(F.col("_text")))
    rows = rows.withColumns({k: FEATURES[k].of(F.col("_text"), F.col("_words")) for k in BASE})
    of = lambda name: F.col(name) if name in BASE else FEATURES[name].of(F.col("_text"), F.col("_words"))
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | F.coalesce(rule.rejects(of), F.lit(False))
    rows = rows.withColumns({"base_failed": base, "rejected_by": cascade(rules, of)})
    return rows.withColumn("kept", F.col("rejected_by").isNull()).drop("_text", "_words")


def rejection(text: Column, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects a text, or null. The text is cut into words once."""
    return let(F.struct(text.alias("t"), words_of(text).alias("w")), lambda x: cascade(rules, lambda name: FEATURES[name].of(x["t"], x["w"])))


def keep_documents(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns. Features are evaluated lazily, inside the cascade."""
    return docs.where(rejection(text_of(text), rules or order_rules(docs, text=text)).isNull())


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the quality rules for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept")


#: The same in SQL; ids are unique in the tables.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM win WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, sum(c) AS n, sum(c) - count(*) AS dup, sum(CASE WHEN regexp_matches(line, '^[ \\t]*[-*•‣·]') THEN c ELSE 0 END) AS bullets
  FROM (SELECT doc_id, line, count(*) AS c FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id, line) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum([length(x) for x in w]), 0) AS word_chars,
  length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  coalesce(lines.n, 0) AS n_lines, coalesce(bullets, 0) AS bullets, len([x for x in w if regexp_matches(x, '\\p{{L}}')]) AS letters
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols > n_words * {MAX_SYMBOLS_PER_WORD}::DOUBLE OR word_chars / greatest(n_words, 1) NOT BETWEEN {MEAN_WORD_CHARS[0]} AND {MEAN_WORD_CHARS[1]}
  OR letters < n_words * {MIN_LETTER_WORD_SHARE}::DOUBLE OR (n_lines >= {MIN_LINES} AND (n_dup_lines > n_lines * {MAX_DUP_LINE_SHARE}::DOUBLE OR bullets > n_lines * {MAX_BULLET_SHARE}::DOUBLE))) AS kept
FROM b
"""

__all__ = ["FEATURES", "OP8_SQL", "RULES", "Feature", "Rule", "cascade", "judge", "keep_documents", "op8_quality_rules", "order_rules", "rejection"]
