"""JSON texts field by field, with the places of the values."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import each, let, regex_spans, sums_before

_TOKEN = re.compile(r'\s*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<mark>[{}\[\]:,])|(?P<bare>[^\s{}\[\]:,"]+))', re.DOTALL | re.ASCII)


def json_fields(text: str | None) -> list[tuple[str | None, str | None, str, int, int]]:
    """(path, key, value, start, end) of every string value; a text that isn't JSON is one field without a path.

    Values are raw (escapes stay); bare tokens pass as values, but aren't fields. Trailing commas are refused.
    """
    text = text or ""
    whole = [(None, None, text, 0, len(text))]
    if text.strip(" \t\r\n")[:1] not in ("{", "["):
        return whole
    tokens, at = [], 0
    body = text.rstrip(" \t\r\n")
    while at < len(body):
        m = _TOKEN.match(text, at)
        if not m:
            return whole
        kind = m.lastgroup
        tokens.append((kind, m[kind], m.start(kind)))
        at = m.end()
    out: list[tuple[str | None, str | None, str, int, int]] = []
    # each open container: [closing mark, path, index, key, state]; states: value, next, key, colon, first
    stack: list[list] = []
    done = False
    for kind, token, start in tokens:
        if done:
            return whole
        top = stack[-1] if stack else None
        if top is None:
            state = "value"
        else:
            state = top[4]
        if kind == "mark" and token in "}]" and top and token == top[0] and state in ("next", "first"):
            stack.pop()
            if not stack:
                done = True
            else:
                stack[-1][4] = "next"
        elif kind == "mark" and token == "," and top and state == "next":
            top[2] += 1
            top[4] = "key" if top[0] == "}" else "value"
        elif kind == "mark" and token == ":" and top and state == "colon":
            top[4] = "value"
        elif kind == "string" and top and top[0] == "}" and state in ("key", "first"):
            top[3] = re.sub(r"\\(.)", r"\1", token[1:-1], flags=re.DOTALL)
            top[4] = "colon"
        elif state == "value" or (state == "first" and top and top[0] == "]"):
            if top is None:
                path, key = "", None
            elif top[0] == "}":
                path, key = (f"{top[1]}.{top[3]}" if top[1] else top[3]), top[3]
            else:
                path, key = f"{top[1]}[{top[2]}]", None
            if kind == "mark":
                if token not in "{[":
                    return whole
                stack.append(["}" if token == "{" else "]", path, 0, None, "first"])
                continue
            if kind == "string":
                out.append((path, key, token[1:-1], start + 1, start + len(token) - 1))
            if top is None:
                done = True
            else:
                top[4] = "next"
        else:
            return whole
    return out if done else whole


#: Patterns of a string and of other tokens; between fields stands what no rule reaches across.
STRING, BARE = '(?s)"(?:[^"\\\\]++|\\\\.)*+"', '[^\\s{}\\[\\]:,"]+'
APART = " " * 64 + "\x00" + " " * 64
#: A container without others in it, in a skeleton: values are b or "".
_FLAT = '\\{(?:"":(?:b|"")(?:,"":(?:b|""))*+)?\\}|\\[(?:(?:b|"")(?:,(?:b|""))*+)?\\]'
FIELD = "struct<key:string,value:string,value_start:int,value_end:int>"


def is_json(text: Column) -> Column:
    """Whether a text is an object or array: strings become "", other tokens b, and containers values, from the inside out.

    Any bare token passes as a value; trailing commas, unclosed containers and text around them don't.
    """
    skeleton = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, STRING, '""'), BARE, "b"), "\\s+", "")

    def closed(s: Column) -> Column:
        opened = F.length(s) - F.length(F.translate(s, "{[", ""))
        return F.aggregate(F.sequence(F.lit(1), opened), s, lambda left, _: F.when(left == "b", left).otherwise(F.regexp_replace(left, _FLAT, "b"))) == "b"

    # the gaps between tokens that touched are gone, so `1 2` must not pass as one value
    return F.when(F.rlike(text, F.lit("^[ \\t\\r\\n]*[{\\[]")), let(skeleton, closed)).otherwise(F.lit(False))


def fields_in(text: Column) -> Column:
    """array<struct<key, value, value_start, value_end>>: the string values of a JSON text, in order; escapes stay in values.

    A string that a colon follows is a key, of the string that comes right after it.
    """

    def of(strings: Column) -> Column:
        key = lambda s: F.regexp_replace(F.regexp_replace(s["value"], '(?s)^"(.*)"\\s*:\\s*$', "$1"), "(?s)\\\\(.)", "$1")

        def field(s: Column, before: Column) -> Column:
            own = F.when(before["end"] == s["start"], key(before))
            return F.struct(own.alias("key"), F.substring(s["value"], F.lit(2), F.length(s["value"]) - 2).alias("value"), (s["start"] + 1).alias("value_start"), (s["end"] - 1).alias("value_end"))

        made = F.transform(strings, lambda s, i: F.when(F.endswith(s["value"], F.lit('"')), field(s, F.get(strings, i - 1))))
        return F.filter(made, lambda f: f.isNotNull())

    return F.when(is_json(text), let(regex_spans(text, STRING + "(?:\\s*:\\s*)?"), of)).otherwise(F.array().cast(f"array<{FIELD}>"))


def with_fields(text: Column) -> Column:
    """struct<text, size, fields array<struct<start, end, shift>>>: the text, followed by its fields if it is JSON.

    Each field stands there as its value after its key in words, far enough from others that no rule sees two of them.
    size is that of the text alone; a field's value is at start to end, and `shift` before that in the text itself.
    """
    plain = F.struct(text.alias("text"), F.length(text).alias("size"), F.array().cast("array<struct<start:int,end:int,shift:int>>").alias("fields"))

    def of(fields: Column) -> Column:
        prefix = lambda f: F.coalesce(F.concat(F.regexp_replace(f["key"], "[_\\-.]", " "), F.lit(": ")), F.lit(""))
        lines = F.transform(fields, lambda f: F.struct(F.concat(prefix(f), f["value"]).alias("line"), F.length(prefix(f)).alias("lead"), f["value_start"].alias("at"), F.length(f["value"]).alias("size")))

        def placed(ls: Column) -> Column:
            first = F.length(text) + len(APART)
            starts = sums_before(F.transform(ls, lambda x: F.length(x["line"]) + len(APART)))
            place = lambda x, s: let(first + s + x["lead"], lambda at: F.struct(at.alias("start"), (at + x["size"]).alias("end"), (at - x["at"]).alias("shift")))
            return F.struct(F.concat(text, F.lit(APART), F.array_join(F.transform(ls, lambda x: x["line"]), APART)).alias("text"), F.length(text).alias("size"), F.zip_with(ls, starts, place).alias("fields"))

        return let(lines, placed)

    return let(fields_in(text), lambda fields: F.when(F.size(fields) > 0, of(fields)).otherwise(plain))


def placed_back(found: Column, whole: Column) -> Column:
    """Findings of `with_fields`'s text as findings of the text: those in a field's value move there, others beyond it go."""

    def back(x: Column) -> Column:
        held = F.get(F.filter(whole["fields"], lambda f: (x["start"] >= f["start"]) & (x["end"] <= f["end"])), F.lit(0))
        moved = let(held["shift"], lambda shift: F.when(shift.isNotNull(), x.withField("start", x["start"] - shift).withField("end", x["end"] - shift)))
        return F.when(x["end"] <= whole["size"], x).otherwise(moved)

    return F.when(F.size(whole["fields"]) > 0, F.filter(F.transform(found, back), lambda x: x.isNotNull())).otherwise(found)


def extract_fields(df: DataFrame, id_col: str = "doc_id", text: str = "json") -> DataFrame:
    """(id, path, key, value, value_start, value_end) for every string value of every text."""
    names = ["id", "path", "key", "value", "value_start", "value_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) for f in json_fields(t)]
            kinds = (batch.schema.field("id").type, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, path string, key string, value string, value_start int, value_end int")


def field_texts(fields: DataFrame) -> DataFrame:
    """Adds `context_text`, the value after its key in words, and `shift`, what to add to offsets in it."""
    words = F.regexp_replace(F.coalesce("key", F.lit("")), "[_\\-.]", " ")
    prefix = F.when(F.col("key").isNull(), "").otherwise(F.concat(words, F.lit(": ")))
    return fields.withColumns({"context_text": F.concat(prefix, F.col("value")), "shift": F.col("value_start") - F.length(prefix)})


def json_secrets(df: DataFrame, id_col: str = "doc_id", text: str = "json") -> DataFrame:
    """(id, path, entity_type, risk_level, start, end, rule_id): findings inside fields, with the key as context."""
    from ..plans.inspection import detect

    found = detect(field_texts(extract_fields(df, id_col, text)), "context_text", id_col="id")
    rows = each(found, "secrets", "id", "path", "value_start", "value_end", "shift")
    rows = rows.select("id", "path", F.col("f.entity_type").alias("entity_type"), F.col("f.risk_level").alias("risk_level"), (F.col("f.start") + F.col("shift")).alias("start"), (F.col("f.end") + F.col("shift")).alias("end"), F.col("f.rule_id").alias("rule_id"), "value_start", "value_end")
    return rows.where("start >= value_start and end <= value_end").drop("value_start", "value_end")
