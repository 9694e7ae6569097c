"""Phrases with derivation junctions: which count, where they begin, and that inspection blocks them."""

from pyspark.sql import functions as F

from veilstream.operators import mnemonics
from veilstream.plans import inspection
from veilstream.sources.wordlists import syllable_wordlist


def test_phrase_uris(spark):
    words = syllable_wordlist(spark)
    by = {r["idx"]: r["word"] for r in words.collect()}
    # entropy of zeros: eleven times the first word, and 0011 of its digest
    phrase = " ".join([by[0]] * 11 + [by[3]])
    n = len(phrase)
    texts = [
        (1, f"{phrase}//Alice///pw x", [(0, n + 12)]),
        (2, f"note 日本 {phrase.upper()}/soft, end", [(8, 8 + n + 6)]),
        (3, f"{phrase} //apart", []),
        (4, " ".join([by[0]] * 12) + "//a", []),
        (5, f"{by[5]} {phrase}//a {phrase}//b", [(5, 8 + n), (9 + n, 12 + 2 * n)]),
        (6, f"x{phrase}//a", []),
        (7, phrase.replace(" ", "  ") + "//a", []),
        (8, None, []),
        (9, "", []),
        (10, "a/b " * 20000 + f"{phrase}//a", [(80000, 80000 + n + 3)]),
    ]
    df = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    table = mnemonics.word_table(words, "english")
    found = df.select("doc_id", mnemonics.phrase_uris(F.coalesce("text", F.lit("")), table).alias("f")).collect()
    assert {r["doc_id"]: [(x["start"], x["end"]) for x in r["f"]] for r in found} == {i: spans for i, _, spans in texts}
    seen = inspection.inspect(df.where("doc_id in (2, 4)"), wordlist=words, pepper="p").collect()
    assert {r["doc_id"]: r["blocked"] for r in seen}[2]
    assert "BLOCKCHAIN_SUBSTRATE_SECRET_URI" in {x["entity_type"] for r in seen if r["doc_id"] == 2 for x in r["findings"]}
