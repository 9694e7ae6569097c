"""What grows with large tables: rows lie in even tasks, and nothing is computed twice."""

from pyspark.sql import functions as F

from veilstream.functions import spans
from veilstream.operators import conversations, mnemonics
from veilstream.plans import queries
from veilstream.plans.queries import QUERIES
from veilstream.sources import tables
from veilstream.sources.planted import planted


def test_planted_rows_are_dealt_evenly(spark, tmp_path):
    """One file with one row group; as many even tasks as the rows need, and no temporary view is left."""
    rows = 3 * tables.TASK_ROWS
    spark.range(rows).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.col("id")).alias("c_name")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = [r["n"] for r in planted(spark, str(tmp_path), "planted_mixed").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 4 and sum(sizes) == rows and max(sizes) <= tables.TASK_ROWS * 1.1
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("customer_")]


def test_each_row_is_searched_once(spark, tmp_path):
    """No filter repeats below the explode what makes the findings."""
    spark.sql("select id as c_custkey, concat('Customer#', id) as c_name from range(9)").write.parquet(f"{tmp_path}/customer.parquet")
    plan = QUERIES["own_rule"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line.split("(")[0]) < 200


def test_each_gives_a_row_for_each_element(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, xs array<string>")
    assert [tuple(r) for r in spans.each(df, "xs", "id").orderBy("id", "f").collect()] == [(1, "a"), (1, "b")]
    assert [tuple(r) for r in spans.each(df, "xs", "id", place="seq").orderBy("seq").collect()] == [(1, 0, "a"), (1, 1, "b")]


def test_the_bits_of_a_phrase_are_made_once():
    assert str(mnemonics.checksum_holds(F.col("words"))).count("bin(") == 1


def test_late_turns_come_in_three_batches(spark, tmp_path, monkeypatch):
    """However many files a table has, there are three batches of the stream."""
    spark.sql("select id % 20 as conv_id, id div 20 as turn, 'user' as role, concat('word ', id) as text from range(160)").repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "shared_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    assert QUERIES["conversation_late"](spark, str(tmp_path)).count() == 160
    assert sum(p.name.isdigit() for p in tmp_path.glob("late/checkpoint/commits/*")) == 3


def _bodies_of_lambdas(plan: str) -> list[str]:
    out = []
    for part in plan.split("lambdafunction(")[1:]:
        depth = 1
        for at, c in enumerate(part):
            depth += (c == "(") - (c == ")")
            if depth == 0:
                out.append(part[:at])
                break
    return out


def test_no_element_of_a_seed_makes_the_row_anew(spark, tmp_path):
    spark.sql("select id as s_suppkey, concat('Supplier#', id) as s_name from range(9)").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    bodies = _bodies_of_lambdas(planted(spark, str(tmp_path), "planted_stellar")._jdf.queryExecution().optimizedPlan().toString())
    assert bodies and not any("sha2(" in b for b in bodies)
    assert not any("lpad(bin(" in b and "substring(ABC" in b for b in bodies)


def test_turns_are_made_of_distinct_keys(spark, tmp_path):
    """No text is made before the keys are distinct, so none is shuffled for it."""
    spark.sql("select id % 5 as l_orderkey, cast(id % 7 as int) as l_linenumber from range(200)").write.parquet(f"{tmp_path}/lineitem.parquet")
    turns = planted(spark, str(tmp_path), "planted_turns")
    assert turns.count() == 35 and turns.dtypes[1] == ("turn", "bigint")
    grouped = [x.split("Aggregate [")[1].split("], [")[0] for x in turns._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in x]
    assert len(grouped) == 1 and "l_orderkey" in grouped[0] and "sha2(" not in grouped[0] and "text" not in grouped[0]


def test_both_variants_of_a_turn_reach_python_in_one_batch(spark):
    turns = spark.createDataFrame([("a", 1, "private key 0x" + "ab" * 10), ("a", 2, "ab" * 10), ("a", 3, "ab" * 12), ("b", 1, "hello")], "conv_id string, turn int, text string")
    found = conversations.cross_turn(turns)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert {(r["conv_id"], r["turn"]) for r in found.where("blocked").collect()} == {("a", 3)}


def test_a_value_held_once_is_no_element_of_an_array():
    """An element of a transformed array walks through the tree of the function for its type, with every row."""
    text = str(spans.let(F.col("x"), lambda v: v + v)) + str(spans.regex_spans(F.col("x"), "a"))
    assert "transform(array(" not in text and "get(transform" not in text


def test_characters_that_part_words(spark):
    """Every code point as by the names of scripts and blocks, of which a text without any from U+2E80 on asks nothing."""
    given = {mnemonics.BREAKS: "[\\p{javaWhitespace}\\p{IsHan}\\p{InCJK_Symbols_and_Punctuation}\\p{InHalfwidth_and_Fullwidth_Forms}]+", mnemonics.HAN: "\\p{IsHan}"}
    points = spark.range(0x110000).where("id not between 55296 and 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for ours, named in given.items():
        assert points.where(F.rlike("c", F.lit(f"^{ours}\\z")) != F.rlike("c", F.lit(f"^{named}\\z"))).count() == 0
        assert points.where(F.rlike("c", F.lit(f"^{ours}\\z"))).count() > 90_000
        assert "\\p{In" not in ours and ours.count("\\p{IsHan}") == ours.count("\\x{2E80}-\\x{10FFFF}&&[\\p{IsHan}]")


def test_words_are_looked_up_only_where_their_lengths_allow_a_run(spark):
    """The gate holds for every text with a run, whatever parts its words, and for no text of words of other lengths."""
    table = mnemonics.WordTable("english", (0,), ("abcd", "bcde", mnemonics.NONE), (0, 1, -1))
    words = lambda n, between=" ": between.join(["abcd"] * n)
    cases = {words(12): 1, words(11): 0, "": 0, "x" * 9 + " " + words(12): 1, "-" + words(12): 0, "-" + words(13): 1, words(11) + " abc": 0, words(12, "　") + "。": 1, "中" + words(12, "中") + "中": 1, "ab  " + words(12, "\n \n") + " ": 1, "\U0001f600bcd " * 12: 1, words(5) + " abcde " + words(11): 0, "\n" + words(12) + "\n": 1}
    got = spark.createDataFrame(list(cases.items()), "text string, runs int").select("runs", mnemonics.may_run(F.col("text"), table, 12).cast("int").alias("got")).collect()
    assert all(r["runs"] == r["got"] for r in got)
    assert "RLIKE" in str(mnemonics.runs_in(F.col("text"), table, 12)).upper().replace("REGEXP_LIKE", "RLIKE")
