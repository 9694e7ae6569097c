"""BIP39 mnemonics inside the row: words looked up in a hash table, runs, windows of allowed lengths, checksums.

The list's words have 11-bit numbers, so it is of bounded size: it becomes a perfect hash table, two array literals of
the plan, and a word costs a hash and a comparison. Hits become a string of 0 and 1, in which a run is a regular
expression; only texts with a long enough run are searched for offsets. Nothing is shuffled or joined, so rows need no
id, and the finder works in streams.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import FINDINGS, chunks, finding, has_context, let, no_findings, regex_spans, sums_before
from .rules import CONTEXT, MNEMONIC_TERMS

#: Lengths of a mnemonic, bits of a word's number, and the classes of Han characters and of those that part words.
COUNTS = (12, 15, 18, 21, 24)
WORD_BITS = 11
#: White space, Han, CJK symbols and punctuation (a block), half and full width forms (a block). A character's script is
#: looked up in a table, so only those from the first Han character on are asked for theirs; blocks are ranges.
HAN = "[\\x{2E80}-\\x{10FFFF}&&[\\p{IsHan}]]"
BREAKS = f"[\\p{{javaWhitespace}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}{HAN}]+"
WORD = "struct<pos:int,start:int,end:int,idx:int>"
#: A word with derivation junctions after it, which ends a phrase that is a seed.
JUNCTIONS = "(?<![0-9A-Za-z])[A-Za-z]+(?:(?<!/)//?(?!/)[^/\\s]+)+(?:///\\S+)?"
#: Buckets and slots of a table; a list has 2,048 words.
BUCKETS, SLOTS = 1024, 8192
#: What stands in an empty slot: no word is a space.
NONE = " "


@dataclass(frozen=True)
class WordTable:
    """A word list as a perfect hash: a word's bucket has a shift, with which it comes to a slot of its own."""

    language: str
    shifts: tuple[int, ...]
    words: tuple[str, ...]
    numbers: tuple[int, ...]

    def _array(self, values: tuple, kind: str) -> Column:
        # one literal, cut up when the plan is made
        return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")

    def slot(self, word: Column) -> Column:
        def of(h: Column) -> Column:
            shift = F.get(self._array(self.shifts, "int"), F.pmod(h, F.lit(BUCKETS)).cast("int"))
            return F.pmod(F.shiftrightunsigned(h, 40) + shift * F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(0xFFFFF)).bitwiseOR(F.lit(1)), F.lit(SLOTS)).cast("int")

        return let(F.xxhash64(word), of)

    def holds(self, word: Column) -> Column:
        return F.get(self._array(self.words, "string"), self.slot(word)) == word

    def number(self, word: Column) -> Column:
        """A listed word's number."""
        return F.get(self._array(self.numbers, "int"), self.slot(word))

    @property
    def chinese(self) -> bool:
        return self.language.startswith("chinese")


def word_table(wordlist: DataFrame, language: str) -> WordTable:
    """The hash table of the list's words of a language. Of a repeated word the lowest number counts."""
    most = 1 << WORD_BITS
    rows = wordlist.where(F.col("lang") == language).groupBy("word").agg(F.min("idx").alias("idx")).select("word", "idx", F.xxhash64("word").alias("h")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a word list has {most} words at most")
    buckets: dict[int, list] = {}
    for r in rows:
        if r["word"] and not r["word"].isspace():
            buckets.setdefault(r["h"] % BUCKETS, []).append(r)
    shifts, words, numbers = [0] * BUCKETS, [NONE] * SLOTS, [-1] * SLOTS
    for bucket, own in sorted(buckets.items(), key=lambda b: (-len(b[1]), b[0])):
        hashes = [r["h"] % (1 << 64) for r in own]
        for shift in range(1 << 20):
            slots = [((h >> 40) + shift * ((h >> 20) & 0xFFFFF | 1)) % SLOTS for h in hashes]
            if len(set(slots)) == len(slots) and all(words[s] == NONE for s in slots):
                break
        shifts[bucket] = shift
        for s, r in zip(slots, own, strict=True):
            words[s], numbers[s] = r["word"], r["idx"]
    return WordTable(language, tuple(shifts), tuple(words), tuple(numbers))


def word_tables(wordlist: DataFrame, languages: tuple = ("english",)) -> list[WordTable]:
    return [word_table(wordlist, language) for language in languages]


def may_run(text: Column, table: WordTable, least: int) -> Column:
    """Whether a text has `least` words in a row as long as listed ones, as any with a run of them has. Not for a Chinese list.

    In small letters only a dotted capital I has another length, and then ends in a dot above.
    """
    sizes = [len(w) for w in table.words if w != NONE] or [1]
    fewest = 1 if any("\u0307" in w for w in table.words) else min(sizes)
    part = BREAKS.removesuffix("+")
    return F.rlike(text, F.lit(f"(?:^|{part})(?:[^{part}]{{{fewest},{max(sizes)}}}+(?:{part}++|\\z)){{{least}}}"))


def runs_in(text: Column, table: WordTable, least: int = 1) -> Column:
    """array<array<struct<pos, start, end, idx>>>: maximal runs of list words in a text, `least` words at least.

    Words part at white space and Han characters; of a Chinese list each Han character is a word, and others part nothing.
    """
    none = F.array().cast(f"array<array<{WORD}>>")
    found = F.regexp_extract_all(text, F.lit(HAN), F.lit(0)) if table.chinese else F.transform(F.split(text, BREAKS, -1), F.lower)

    def placed() -> Column:
        """Every word with its place."""
        if table.chinese:
            return F.transform(regex_spans(text, HAN), lambda s, i: F.struct(i.alias("pos"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("low")))
        gaps = F.concat(F.regexp_extract_all(text, F.lit(BREAKS), F.lit(0)), F.array(F.lit("")))
        words = F.zip_with(F.split(text, BREAKS, -1), gaps, lambda w, g: F.struct(F.lower(w).alias("low"), F.length(w).alias("size"), (F.length(w) + F.length(g)).alias("step")))
        starts = lambda ws: sums_before(F.transform(ws, lambda w: w["step"]))
        word = lambda w, s: F.struct(s.alias("start"), (s + w["size"]).alias("end"), w["low"].alias("low"))
        return let(words, lambda ws: F.transform(F.zip_with(ws, starts(ws), word), lambda w, i: F.struct(i.alias("pos"), w["start"].alias("start"), w["end"].alias("end"), w["low"].alias("low"))))

    def of(marks: Column) -> Column:
        islands = regex_spans(marks, f"1{{{least},}}")
        word = lambda w: F.struct(w["pos"].alias("pos"), w["start"].alias("start"), w["end"].alias("end"), table.number(w["low"]).alias("idx"))
        taken = let(placed(), lambda words: F.transform(islands, lambda i: F.transform(F.slice(words, i["start"] + 1, i["end"] - i["start"]), word)))
        return F.when(F.contains(marks, F.lit("1" * least)), taken).otherwise(none)

    if not table.chinese and least > 1:
        found = F.when(may_run(text, table, least), found).otherwise(F.array().cast("array<string>"))
    return let(F.array_join(F.transform(found, lambda w: F.when(table.holds(w), "1").otherwise("0")), ""), of)


def runs(df: DataFrame, wordlist: DataFrame, lang: str = "english", id_col: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(id, run, n, words array<struct<pos, start, end, idx>>) of maximal runs of list words, `least` at least; run counts them."""
    found = runs_in(F.coalesce(F.col(text), F.lit("")), word_table(wordlist, lang), least)
    return df.select(F.col(id_col).alias("id"), F.posexplode(found).alias("run", "words")).select("id", "run", F.size("words").cast("long").alias("n"), "words")


def bits_of(indices: Column) -> Column:
    """The words' 11-bit numbers as a string of 0 and 1."""
    return F.array_join(F.transform(indices, lambda i: F.lpad(F.bin(i.cast("long")), WORD_BITS, "0")), "")


def bits_hold(bits: Column, count: Column) -> Column:
    """Whether the last bits of a window are the first of SHA-256 over those before them: of 3 words 32 bits and one.

    bits: of the window's words, which are `count`. A column that isn't a plain one is computed for each use.
    """
    third = (count / 3).cast("int")
    parts = F.transform(F.sequence(F.lit(0), third - 1), lambda k: F.lpad(F.conv(F.substring(bits, k * 32 + 1, F.lit(32)), 2, 16), 8, "0"))
    digest = F.sha2(F.unhex(F.array_join(parts, "")), 256)
    return F.substring(F.lpad(F.conv(F.substring(digest, 1, 2), 16, 2), 8, "0"), F.lit(1), third) == F.substring(bits, third * 32 + 1, third)


def checksum_holds(indices: Column) -> Column:
    """Whether the words of a phrase of an allowed length, given as numbers, end in their checksum."""
    return let(F.struct(bits_of(indices).alias("bits"), F.size(indices).alias("n")), lambda x: bits_hold(x["bits"], x["n"]))


def windows_in(text: Column, table: WordTable, check_checksum: bool = True) -> Column:
    """array<struct<start, end, n_words, checksum, near>> of every window of an allowed length in a run; windows may overlap."""
    kind = "struct<start:int,end:int,n_words:int,checksum:boolean,near:boolean>"

    def of(run: Column, whole: Column) -> Column:
        """whole: the text's chunks, and whether it has a term at all."""

        def windows(bits: Column) -> Column:
            def window(i: Column, c: Column) -> Column:
                start, end = F.get(run, i)["start"], F.get(run, i + c - 1)["end"]
                sure = let(F.substring(bits, i * WORD_BITS + 1, c * WORD_BITS), lambda own: bits_hold(own, c)) if check_checksum else F.lit(False)
                near = F.when(whole["named"], has_context(text, start, end, MNEMONIC_TERMS, CONTEXT, whole["pieces"])).otherwise(F.lit(False))
                return F.struct(start.alias("start"), end.alias("end"), c.alias("n_words"), sure.alias("checksum"), near.alias("near"))

            starts = lambda c: F.when(F.size(run) >= c, F.sequence(F.lit(0), F.size(run) - c)).otherwise(F.array().cast("array<int>"))
            return F.flatten(F.transform(F.array(*map(F.lit, COUNTS)), lambda c: F.transform(starts(c), lambda i: window(i, c))))

        return let(bits_of(F.transform(run, lambda w: w["idx"])) if check_checksum else F.lit(""), windows)

    named = let(F.lower(text), lambda low: F.exists(F.array(*(F.lit(t.lower()) for t in MNEMONIC_TERMS)), lambda t: F.contains(low, t)))
    whole = F.struct(chunks(text).alias("pieces"), named.alias("named"))
    found = let(runs_in(text, table, min(COUNTS)), lambda rs: F.when(F.size(rs) > 0, let(whole, lambda w: F.flatten(F.transform(rs, lambda r: of(r, w))))).otherwise(F.array().cast(f"array<{kind}>")))
    return F.filter(found, lambda w: w["checksum"] | w["near"])


def _risk(w: Column) -> tuple[Column, Column]:
    return F.when(w["checksum"], "CRITICAL").otherwise("HIGH"), F.when(w["checksum"], 0.99).otherwise(0.6)


def mnemonic_findings(text: Column, tables: list[WordTable], check_checksum: bool = True) -> Column:
    """array<finding> of a text's mnemonics, by start and end; languages in their order."""

    def of(table: WordTable) -> Column:
        made = lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), finding(w, "MNEMONIC", *_risk(w), "bip39-mnemonic", "list words in a row").alias("f"))
        return F.transform(F.array_sort(F.transform(windows_in(text, table, check_checksum), made)), lambda x: x["f"])

    return F.concat(no_findings(), *map(of, tables)).cast(FINDINGS)


def phrase_uris(text: Column, table: WordTable) -> Column:
    """array<finding> of phrases with derivation junctions right after the last word: our reading of the public URI grammar.

    Of the list words before the junctions, each after one white space, as many count as make the longest phrase of an
    allowed length with a checksum that holds. Words of a list are of bounded length, so are the words looked at. A list
    without white space between its words has no such phrases.
    """
    if table.chinese:
        return no_findings()
    most, longest = max(COUNTS), max((len(w) for w in table.words if w != NONE), default=0)
    width = (most - 1) * (longest + 1)

    def phrase(span: Column, words: Column) -> Column:
        """words: those before the junctions, last first; null where they make no phrase."""
        marks = F.array_join(F.transform(words, lambda w: F.when(table.holds(F.lower(w)), "1").otherwise("0")), "")
        numbers = lambda c: F.reverse(F.transform(F.slice(words, 1, c), lambda w: table.number(F.lower(w))))
        holds = lambda run: F.filter(F.array(*map(F.lit, COUNTS)), lambda c: (c <= run) & F.when(c <= run, let(numbers(c), checksum_holds)).otherwise(F.lit(False)))
        count = let(F.length(F.regexp_extract(marks, "^1*", 0)), lambda run: F.array_max(holds(run)))
        size = lambda c: F.length(F.array_join(F.slice(words, 2, c - 1), " ")) + 1
        return let(count, lambda c: F.when(c.isNotNull(), F.struct((span["start"] - size(c)).cast("int").alias("start"), span["end"].alias("end"))))

    def of(span: Column) -> Column:
        low = F.greatest(span["start"] - width, F.lit(0))
        before = F.reverse(F.split(F.substring(text, low + 1, span["start"] - low), "\\s", -1))
        # the junctions' own word follows white space, so the last part before it is empty
        words = F.concat(F.array(F.regexp_extract(span["value"], "^[A-Za-z]+", 0)), F.slice(before, 2, most - 1))
        return F.when(F.get(before, F.lit(0)) == "", let(words, lambda w: phrase(span, w)))

    found = F.filter(F.transform(regex_spans(text, JUNCTIONS, F.contains(text, F.lit("/"))), of), lambda x: x.isNotNull())
    return F.transform(found, lambda s: finding(s, "BLOCKCHAIN_SUBSTRATE_SECRET_URI", "CRITICAL", 0.95, "substrate-secret-uri", "phrase with junctions"))


def mnemonics(df: DataFrame, wordlist: DataFrame, languages: tuple = ("english",), id_col: str = "doc_id", text: str = "text", check_checksum: bool = True) -> DataFrame:
    """(id, start, end, n_words, checksum, risk_level, confidence) of every window that counts; windows may overlap."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*(windows_in(t, table, check_checksum) for table in word_tables(wordlist, languages)))
    rows = df.select(F.col(id_col).alias("id"), F.explode(found).alias("w"))
    risk, sure = _risk(F.col("w"))
    return rows.select("id", "w.start", "w.end", "w.n_words", "w.checksum", risk.alias("risk_level"), sure.alias("confidence"))
