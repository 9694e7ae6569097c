"""Word lists as tables (lang, word, idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_wordlist(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """A UTF-8 file with a word a line: trimmed, blank lines skipped, numbered in order. A missing file fails when read."""
    rows = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\\r?\\n")).alias("line", "word"))
    rows = rows.select("line", F.trim("word").alias("word")).where("word != ''")
    return rows.select(F.lit(lang).alias("lang"), "word", (F.row_number().over(Window.orderBy("line")) - 1).alias("idx"))


def syllable_wordlist(spark: SparkSession, lang: str = "english") -> DataFrame:
    """A list of 2,048 words made by a rule (two syllables of 64 and 32), for tests and planted texts."""
    first = F.expr("concat(substring('bcdfghjklmnpqrst', cast(floor(id / 128) as int) + 1, 1), substring('aeio', cast(floor(id / 32) % 4 as int) + 1, 1))")
    second = F.expr("concat(substring('bdfgklmn', cast(floor(id / 4) % 8 as int) + 1, 1), substring('aeio', cast(id % 4 as int) + 1, 1))")
    return spark.range(2048).select(F.lit(lang).alias("lang"), F.concat(first, second).alias("word"), F.col("id").cast("int").alias("idx"))


def han_wordlist(spark: SparkSession, lang: str = "chinese") -> DataFrame:
    """A list of 2,048 characters in a row, from the first Han one, for tests and planted texts."""
    sign = F.decode(F.unhex(F.hex((F.col("id") + 0x4E00).cast("int"))), "UTF-16BE")
    return spark.range(2048).select(F.lit(lang).alias("lang"), sign.alias("word"), F.col("id").cast("int").alias("idx"))
