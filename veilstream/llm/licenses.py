"""License scans by template markup.

A template is a license's wording with marked regions: `<<opt>> ... <<end>>` may be missing, `<<any:N>>` stands for
any 0 to N words, such as a holder's name. Each template compiles into an automaton over words, and a text holds the
license where the automaton accepts a run of its words: mandatory wording must match exactly. Words are compared in
lower case, without punctuation. Plain phrases ("mit license") are labelled beside that. A template needs a word
outside its optional regions. A run begins as far before its first mandatory word as the template allows.

Defined results: a null or empty text has no words, no labels and score 0. Overlapping places of a phrase all
count. Rows that repeat a document are judged each. The work for a text grows with its length and its places, however
long it is. An empty table gives an empty result. Only the id and what the scan finds come back, whatever other
columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, table

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wordings of public licenses.
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
MIT_REST = (
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
    "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<any:8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
    'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<any:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS."
)
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = (
    "<<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
BSD_THIRD = (
    "<<opt>>3.<<end>> Neither the name of <<any:8>> nor the names of <<opt>>its<<end>> contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission."
)
BSD_DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY <<any:8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "<<opt>>http<<end>> <<any:6>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
)
GPL_NOTICE = (
    "<<any:4>> is free software<<opt>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU <<opt>>Lesser<<end>> General Public License as published by the Free Software "
    "Foundation, either version <<any:1>> of the License, or <<opt>>(at your option)<<end>> any later version."
)

#: Wordings of public licenses in our markup: label, template.
TEMPLATES = [
    ("mit-notice", "Released under the <<opt>>terms of the<<end>> MIT License"),
    ("apache-2.0", "Licensed under the Apache License<<opt>>,<<end>> Version 2.0"),
    ("gpl-3.0", "This <<any:6>> is licensed under the GNU General Public License <<opt>>version<<end>> 3"),
    ("gpl-2.0", "This <<any:6>> is licensed under the GNU General Public License <<opt>>version<<end>> 2"),
    ("cc-by-nc-4.0", "Licensed under <<opt>>a Creative Commons<<end>> CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under <<opt>>a Creative Commons<<end>> CC BY 4.0"),
    ("copyright", "Copyright <<opt>>(c)<<end>> <<any:6>> All rights reserved"),
    ("mit-grant", MIT_GRANT),
    ("mit-full", f"<<opt>>Copyright <<opt>>(c)<<end>> <<any:12>><<end>> {MIT_GRANT} {MIT_REST}"),
    ("isc-full", ISC),
    ("bsd-clause", BSD_GRANT),
    ("bsd-2-clause", f"{BSD_GRANT} {BSD_TWO} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{BSD_GRANT} {BSD_TWO} {BSD_THIRD} {BSD_DISCLAIMER}"),
    ("apache-2.0-notice", APACHE_NOTICE),
    ("gpl-notice", GPL_NOTICE),
]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Word automaton of a template: states are places in the wording; optional regions and gaps are edges without a word."""

    def __init__(self, label: str, template: str) -> None:
        self.label = label
        #: by state: (word or None for any word, next state); and states reached without a word
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.mandatory: list[bytes] = []
        opens: list[int] = []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<opt>>":
                opens.append(len(self.steps) - 1)
            elif part == "<<end>>":
                self.free[opens.pop()].append(len(self.steps) - 1)
            elif part.startswith("<<any:"):
                first = len(self.steps) - 1
                for _ in range(int(part[6:-2])):
                    self._add(None)
                for s in range(first, len(self.steps) - 1):
                    self.free[s].append(len(self.steps) - 1)
            else:
                for w in words(part.encode()):
                    self._add(w)
                    if not opens:
                        self.mandatory.append(w)
        self.accept = len(self.steps) - 1
        if not self.mandatory:
            raise ValueError(f"template {label!r} has no word outside its optional regions")
        #: words that a run may have before its first mandatory word
        self.lead = next(s for s, step in enumerate(self.steps) if step and step[0] == (self.mandatory[0], s + 1) and s not in self._skipped())

    def _skipped(self) -> set[int]:
        """States inside regions that may be missing."""
        return {s for a, ends in enumerate(self.free) for end in ends for s in range(a, end)}

    def _add(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append([])

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, ws: list[bytes], start: int) -> int:
        """End of the longest run from start that the automaton accepts, or -1."""
        states, end = self._closed({0}), -1
        for at in range(start, len(ws) + 1):
            if self.accept in states:
                end = at
            if at == len(ws):
                break
            states = self._closed({n for s in states for w, n in self.steps[s] if w is None or w == ws[at]})
            if not states:
                break
        return end


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]) -> None:
        self.phrases = [(b" " + b" ".join(words(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.automata = [Automaton(*t) for t in templates]
        self.needed = [(a, set(a.mandatory), b" " + a.mandatory[0] + b" ") for a in self.automata]

    def scan(self, text: bytes | None) -> tuple[int, list[int], set[str], list[tuple[str, int, int]]]:
        """(words, starts of phrases, labels of phrases, (label, start, end) of templates)"""
        ws = words(text)
        line = b" " + b" ".join(ws) + b" "
        starts, labels = [], set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts.append(int(np.searchsorted(spaces, at)))
                labels.add(label)
                at = line.find(phrase, at + 1)
        found = []
        for automaton, mandatory, first in self.needed:
            if first not in line or not all(b" " + w + b" " in line for w in mandatory):
                continue
            at = line.find(first)
            while at >= 0:
                must = int(np.searchsorted(spaces, at))
                for start in range(max(0, must - automaton.lead), must + 1):
                    end = automaton.match(ws, start)
                    if end > must:
                        found.append((automaton.label, start, end))
                        break
                at = line.find(first, at + 1)
        return len(ws), sorted(starts), labels, found


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, starts, base_labels, matches) for every row of docs; matches: array<struct<label, start, end>>."""
    scanner = Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = [scanner.scan(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([sorted(x[2]) for x in out], pa.list_(pa.string())), pa.array([[dict(zip(("label", "start", "end"), m, strict=True)) for m in x[3]] for x in out], kind)],
                names=["doc_id", "n_words", "starts", "base_labels", "matches"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, starts array<long>, base_labels array<string>, matches array<struct<label string, start long, end long>>")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the license scan of all documents.

    score: 0.5 with phrases alone; with accepted templates it rises from there to 1 with the words of the longest run.
    """
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    longest = F.coalesce(F.array_max(F.transform("matches", lambda m: m["end"] - m["start"])), F.lit(0))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(longest > 0, F.lit(1.0) - F.lit(0.5) * F.pow(F.lit(0.9), longest)).when(F.size("starts") > 0, 0.5).otherwise(0.0).alias("score"),
    )
