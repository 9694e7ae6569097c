"""Token counts by offset-mapped attribution.

A document is its fields, put together in order, each with the separator that follows it. It is encoded once, as a
whole, so tokens are those that a model would see. Each token's span comes from the lengths of the tokens before
it, and an interval join (binary search in the sorted section bounds) finds the sections that the span meets.

Rule for tokens that cross a boundary: the section with most of the token's bytes gets it, the earlier of equals.
So every token counts once, and the counts of a document's sections add up to its tokens.

Defined results: a null field is empty; a section without tokens has count 0. Rows that repeat a document are each
counted. Texts of any length are encoded, white space of any length too. An empty table gives an empty result. Only the id and the counts come back.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Fixed value: the white space of the pattern. The encoder's stack ends at about a million characters of it in a row.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def cut(text: str) -> Iterator[tuple[bool, str]]:
    """(whether it is one piece, part): parts of a text that encode to what the whole does, long white space apart.

    White space before a word is one piece without its last character, which goes with the word; at the end it is one
    piece. The pattern looks ahead, never back, and nothing else in it ends with white space.
    """
    at = 0
    for m in LONG_SPACE.finditer(text):
        end = m.end() - (m.end() < len(text))
        yield False, text[at : m.start()]
        yield True, text[m.start() : end]
        at = end
    yield False, text[at:]


@lru_cache(maxsize=4)
def encoder(path: str):
    """(encode, byte length of each id), once in a Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    words, piece = (tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for name, pattern in (("own", PATTERN), ("piece", r"[\s\S]+")))

    def encode(text: str) -> list[int]:
        if not LONG_SPACE.search(text):
            return words(text)
        return [t for whole, part in cut(text) for t in (piece if whole else words)(part)]

    return encode, lengths


def attribute(ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens among them) by section: tokens end at `ends`; section k is bounds[k] to bounds[k + 1]."""
    sections = len(bounds) - 1
    starts = np.concatenate(([0], ends[:-1]))
    # the sections of a token's first and last byte; empty sections hold no byte
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    owner = first.copy()
    crossing = np.flatnonzero(first != last)
    for i in crossing:
        inside = np.minimum(bounds[first[i] + 1 : last[i] + 2], ends[i]) - np.maximum(bounds[first[i] : last[i] + 1], starts[i])
        owner[i] = first[i] + int(np.argmax(inside))
    return np.bincount(owner, minlength=sections), np.bincount(owner[crossing], minlength=sections)


def count_tokens(docs: DataFrame, fields: dict[str, Column], id_col: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, section, n_tokens, n_crossing, n_chars): a row for every row of docs and every field, in the fields' order."""
    names = list(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for parts in batch.column("parts"):
                parts = parts.as_py()
                tokens = np.array(encode("".join(parts)), np.int64)
                bounds = np.cumsum([0, *(len(p.encode()) for p in parts)])
                counts, crossing = attribute(np.cumsum(lengths[tokens]), bounds) if len(tokens) else (np.zeros(len(parts), np.int64),) * 2
                for to, x in zip(out, (names, counts, crossing, [len(p) for p in parts]), strict=True):
                    to.extend(x)
            ids = np.repeat(np.arange(len(batch)), len(names))
            yield pa.record_batch([batch.column("doc_id").take(pa.array(ids)), pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["doc_id", "section", "n_tokens", "n_crossing", "n_chars"])

    parts = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in fields.values()))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), parts.alias("parts")).mapInArrow(run, "doc_id long, section string, n_tokens long, n_crossing long, n_chars long")


def document_fields(text: str = "text") -> dict[str, Column]:
    """Sections of a training document: source and language as a header, the first line, and the rest of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    at = F.locate("\n", t)
    ended = lambda c: F.concat(F.coalesce(c, F.lit("")), F.lit("\n"))
    return {
        "source": ended(F.col("source")),
        "lang": ended(F.col("lang")),
        "first_line": F.when(at > 0, F.substring(t, F.lit(1), at)).otherwise(t),
        "rest": F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise(F.lit("")),
    }


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every document's sections."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return count_tokens(docs, document_fields())
