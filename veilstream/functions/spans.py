"""Spans in a text as array columns: regex extraction, merging, masking. Offsets are code points, from 0, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A finding inside a row. seq is the order of emission.
FINDING = "struct<entity_type:string,risk_level:string,confidence:double,start:int,end:int,rule_id:string,reason:string>"
FINDINGS = f"array<{FINDING}>"
RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
SPAN = "struct<start:int,end:int,value:string>"
#: The least elements of a block of running totals, and code points of a chunk.
BLOCK, CHUNK = 32, 1024


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row.

    A fold over nothing, which ends in body. (An element of a transformed array would walk through the whole tree of
    body for its type, with every row.)
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def let_sql(name: str, value: str, body: str) -> str:
    """`let` in an expression that is written out: body names the value."""
    return f"aggregate(cast(array() as array<int>), {value}, ({name}, nothing) -> {name}, {name} -> {body})"


#: Running totals of an array a, without the element itself, folded by {f} from {zero}: totals of blocks of about the
#: square root of its size, then within a block. Written out, so that a plan with many patterns is built fast. (A fold that
#: gathers an array copies it with each step.)
_RUNNING = let_sql(
    "width", "greatest({least}, cast(ceil(sqrt(size({a}))) as int))",
    let_sql(
        "totals", "transform(sequence(0, (size({a}) - 1) div width), k -> aggregate(slice({a}, k * width + 1, width), {zero}, (p, q) -> {f}))",
        let_sql(
            "bases", "transform(totals, (total, k) -> aggregate(slice(totals, 1, k), {zero}, (p, q) -> {f}))",
            "transform({a}, (value, i) -> aggregate(slice({a}, i div width * width + 1, i % width), get(bases, i div width), (p, q) -> {f}))",
        ),
    ),
)
_ADD, _MOST = {"zero": "0", "f": "p + q"}, {"zero": str(-(2**31)), "f": "greatest(p, q)"}


def _applied(value: Column, body: Column) -> Column:
    """`let` for a body that is written out as a function."""
    return F.call_function("aggregate", F.array().cast("array<int>"), value, F.expr("(held, nothing) -> held"), body)


def _running(array: Column, how: dict) -> Column:
    body = F.expr(f"a -> if(size(a) = 0, a, {_RUNNING.format(a='a', least=BLOCK, **how)})")
    return _applied(array.cast("array<int>"), body)


def sums_before(array: Column) -> Column:
    """For each number of an array the sum of those before it."""
    return _running(array, _ADD)


def most_before(array: Column) -> Column:
    """For each number of an array the greatest of those before it; for the first the least integer."""
    return _running(array, _MOST)


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, for `cut`."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut_up(text: Column) -> Column:
    """(pieces, size): a text's chunks and its length, both found once however many parts are cut from it."""
    return F.struct(chunks(text).alias("pieces"), F.length(text).alias("size"))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end, from its chunks: costs the length of the part, wherever in the text it stands."""
    first = F.floor(start / CHUNK).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.greatest(F.floor((end - 1) / CHUNK).cast("int") - first + 1, F.lit(0))), "")
    return F.substring(part, start - first * CHUNK + 1, F.greatest(end - start, F.lit(0)))


_NO_SPANS = f"cast(array() as array<{SPAN}>)"
_PLACED = f"zip_with(found, zip_with(gaps, {_RUNNING.format(a='steps', least=BLOCK, **_ADD)}, (g, at) -> at + g), (v, at) -> named_struct('start', at, 'end', at + length(v), 'value', v))"
_GAPS = "transform(slice(split(t, {pattern}, -1), 1, size(found)), g -> length(g))"
_SOME = let_sql("gaps", _GAPS, let_sql("steps", "zip_with(found, gaps, (v, g) -> g + length(v))", _PLACED))
_SPANS = "t -> " + let_sql("found", "regexp_extract_all(t, {pattern}, 0)", f"if(size(found) = 0, {_NO_SPANS}, {_SOME})")


def regex_spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in order.

    The parts between matches and the matches themselves give every offset, so no UDF is needed. A text without a
    match is searched once. gate: a cheap predicate that holds for every text with a match; others aren't searched.
    """
    quoted = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = F.expr(_SPANS.format(pattern=quoted))
    spans = _applied(text, body)
    return spans if gate is None else F.when(gate, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def finding(span: Column, entity: str | Column, risk: str | Column, confidence: float | Column, rule: str, reason: str) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(col(entity).alias("entity_type"), col(risk).alias("risk_level"), col(confidence).cast("double").alias("confidence"), span["start"].alias("start"), span["end"].alias("end"), F.lit(rule).alias("rule_id"), F.lit(reason).alias("reason"))


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def each(df: DataFrame, array: str, *columns: str | Column, place: str | None = None) -> DataFrame:
    """A row for each element f of an array column that has no nulls, with the columns given; place: the name of its number.

    Of an inner explode Spark infers that the array isn't empty and moves this test below the projections that make the
    array, which then run once for the test and once for the rows, with each column in each place that it is used.
    """
    made = F.explode_outer(array).alias("f") if place is None else F.posexplode_outer(array).alias(place, "f")
    return df.select(*columns, made).where(F.col("f").isNotNull())


def has_context(text: Column, start: Column, end: Column, terms: list[str], width: int, pieces: Column | None = None) -> Column:
    """Whether any term stands in the text from `width` before the span to `width` after it, in any case.

    pieces: `chunks` of the text, where a text may have many candidates.
    """
    low = F.greatest(start - width, F.lit(0))
    near = F.lower(F.substring(text, low + 1, end + width - low) if pieces is None else cut(pieces, low, end + width))
    return F.coalesce(let(near, lambda x: F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(x, t))), F.lit(False))


def risk_order(risk: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RISKS)), risk), F.lit(0)).cast("int")


def by_position(found: Column) -> Column:
    """Sorted by start, then longest first, then order of emission."""
    keyed = F.transform(found, lambda x, i: F.struct(x["start"].alias("a"), (-x["end"]).alias("b"), i.alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def merge(found: Column) -> Column:
    """Overlapping findings become one span; the highest risk names it, the first of equals. Touching spans stay apart.

    A span begins a new one where it starts at or after the end of all before it.
    """

    def island(part: Column) -> Column:
        first = F.get(part, F.lit(0))
        best = F.aggregate(part, first, lambda a, x: F.when(risk_order(x["risk_level"]) > risk_order(a["risk_level"]), x).otherwise(a))
        return let(best, lambda x: x.withField("start", first["start"]).withField("end", F.array_max(F.transform(part, lambda y: y["end"]))))

    def of(f: Column) -> Column:
        reach = most_before(F.transform(f, lambda x: x["end"]))
        begins = F.filter(F.zip_with(F.sequence(F.lit(0), F.size(f) - 1), F.zip_with(f, reach, lambda x, r: x["start"] >= r), lambda i, new: F.when(new, i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda i, k: island(F.slice(f, i + 1, F.coalesce(F.get(b, k + 1), F.size(f)) - i))))

    return let(found, lambda f: F.when(F.size(f) > 1, let(by_position(f), of)).otherwise(f))


def merge_within_type(found: Column) -> Column:
    """merge for each entity type on its own; types in order of their first finding."""
    return let(found, lambda f: F.flatten(F.transform(F.array_distinct(F.transform(f, lambda x: x["entity_type"])), lambda t: merge(F.filter(f, lambda x: x["entity_type"] == t)))))


def clipped(text: Column, start: Column, end: Column) -> Column:
    """The part of the text that a span covers, or null where that is empty."""
    s, e = F.greatest(start, F.lit(0)), F.least(end, F.length(text))
    return F.when(e > s, F.substring(text, s + 1, e - s))


def replace_spans(text: Column, found: Column, replacement) -> Column:
    """The text with every span of `found` (disjoint, in order) replaced by replacement(finding, raw)."""

    def whole(t: Column) -> Column:
        pieces, size = t["pieces"], t["size"]
        clip = lambda x: F.struct(F.greatest(x["start"], F.lit(0)).alias("s"), F.least(x["end"], size).alias("e"), x.alias("x"))

        def masked(kept: Column) -> Column:
            until = lambda i: F.coalesce(F.get(kept, i)["e"], F.lit(0))
            parts = F.transform(kept, lambda c, i: F.concat(cut(pieces, until(i - 1), c["s"]), replacement(c["x"], cut(pieces, c["s"], c["e"]))))
            return F.concat(F.array_join(parts, ""), cut(pieces, until(F.size(kept) - 1), size))

        return let(F.filter(F.transform(found, clip), lambda c: c["e"] > c["s"]), masked)

    return F.when(F.size(found) > 0, let(cut_up(text), whole)).otherwise(text)
