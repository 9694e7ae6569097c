"""URL filters: listed rules first, then association rules that FP-growth mines from labelled pages.

A URL becomes a set of tokens (host labels, path segments, query parts). FP-growth finds token sets that go along
with bad labels; rules on fewer than MIN_PAGES bad pages or below the confidence bound are dropped, whatever the table's
size. A rule can hold only tokens of that many bad pages, so others are left out before mining. What is mined is exact for
the verdicts, though not every set is enumerated: see `mine`. Each rule that is left is filed in an inverted index under
the rarest item of its antecedent, so a URL meets only rules that share a token with it.

Defined results: a null URL, and one without `://`, have an empty host and path, no listed rule, no tokens, and
the verdict allow. Repeated pages get the same verdict each; pages without a label, and labels of no page, take no
part in mining. A very long URL is cut into tokens whole. Other columns, whatever their names, don't matter. With no labelled page, or none that is bad, no rule is mined. Of listed rules that fit the longest
string wins, and of equally long ones the first by code point. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize, table

#: Listed rules: host and path, verdict.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: A rule rests on this many bad pages at least, however many pages are labelled.
MIN_PAGES = 5
MIN_CONFIDENCE = 0.6
BAD = "!bad"
#: An index of up to this many rules is broadcast; a larger one is joined by shuffling.
BROADCAST_RULES = 50_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest listed rule that fits, or null. One CASE, longest rule first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        rule_host, slash, rest = rule.partition("/")
        fits = (host == rule_host) | host.endswith(f".{rule_host}")
        out = F.when(fits & path.startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens: h:label of the host, p:segment of the path, q:part of the query."""
    rest = F.coalesce(F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1), F.lit(""))
    parts = lambda c, by, kind: F.transform(F.filter(F.split(c, by, -1), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(parts(host_of(url), "\\.", "h:"), parts(path_of(url), "/", "p:"), parts(rest, "&", "q:")))


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(token, antecedent, any_of array<array<string>>, confidence, support) from labelled (url, bad boolean).

    A URL meets a rule if it has a token of each array of any_of; the rule is filed under each token of its rarest one.
    Tokens that make a rule alone leave the mining, since longer rules with them block nothing more; those of the same
    pages are told once more as the closed set that they are. Other tokens of the same labelled pages can't be told
    apart there: they are mined as one item, which a URL has with any of them and the antecedent names by the first.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "token string, antecedent array<string>, any_of array<array<string>>, confidence double, support double")
    sets = labelled.select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad")).where((F.size("tokens") > 0) | F.col("bad"))
    sets = materialize(sets.withColumn("id", F.expr("uuid()")), "url-tokens")
    rows, bad = sets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    if bad < min_pages:
        discard(sets)
        return none
    holds = lambda c: (c >= min_confidence) & (c > bad / rows)
    # tokens of enough bad pages; `pages` names the set of pages by two sums of hashes
    use = sets.select("id", "bad", F.explode("tokens").alias("token"))
    named = [F.sum(F.xxhash64("id", F.lit(k)).cast("decimal(20,0)")) for k in range(2)]
    single = use.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.count_if("bad").alias("_bad"), F.concat_ws(",", *(n.cast("string") for n in named)).alias("pages")).where(F.col("_bad") >= min_pages)
    single = materialize(single.withColumn("confidence", F.col("_bad") / F.col("freq")), "url-frequent")
    sure = single.where(holds(F.col("confidence"))).select("token", "confidence", (F.col("_bad") / rows).alias("support"), "pages")
    closed = sure.groupBy("pages", "confidence", "support").agg(F.array_sort(F.collect_list("token")).alias("antecedent")).where(F.size("antecedent") > 1)
    alone = sure.select("token", F.array("token").alias("antecedent"), "confidence", "support").unionByName(closed.select(F.get("antecedent", F.lit(0)).alias("token"), "antecedent", "confidence", "support"))
    alone = alone.select("token", "antecedent", F.transform("antecedent", lambda t: F.array(t)).alias("any_of"), "confidence", "support")
    items = single.where(~holds(F.col("confidence"))).groupBy("freq", "_bad", "pages").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("any"))
    items = materialize(items.select("item", "any", "freq"), "url-items")
    # the sets that make rules are frequent among bad pages, which alone are mined
    used = use.join(items.select("item", F.explode("any").alias("token")), "token").groupBy("id", "bad").agg(F.collect_set("item").alias("items"))
    used = materialize(used, "url-used")
    mined = used.where("bad").select("items")
    held = mined.count()
    if not held:
        return alone
    # half a page less, so that rounding never asks for one more
    found = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / held).fit(mined).freqItemsets.where(F.size("items") > 1)
    found = materialize(found.select(F.array_sort("items").alias("set"), F.col("freq").alias("_bad")), "url-sets")
    filed = found.withColumn("item", F.explode("set")).join(items, "item")
    filed = filed.groupBy("set", "_bad").agg(F.min_by("item", F.struct("freq", "item")).alias("item"), F.min_by("any", F.struct("freq", "item")).alias("keys"), F.collect_list("any").alias("any_of"))
    # the good pages of a set are found by its rarest item
    good = used.where("not bad").groupBy(F.array_sort("items").alias("items")).agg(F.count(F.lit(1)).alias("_n"))
    good = good.select("items", "_n", F.explode("items").alias("item"))
    met = filed.select("item", "set").join(good, "item").where(F.size(F.array_except("set", "items")) == 0).groupBy("set").agg(F.sum("_n").alias("_good"))
    rules = filed.join(met, "set", "left").withColumn("confidence", F.col("_bad") / (F.col("_bad") + F.coalesce("_good", F.lit(0)))).where(holds(F.col("confidence")))
    rules = rules.select(F.explode("keys").alias("token"), F.col("set").alias("antecedent"), "any_of", "confidence", (F.col("_bad") / rows).alias("support"))
    rules = materialize(alone.unionByName(rules), "url-rules")
    discard(sets, single, items, used, found)
    return rules


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for every row of pages; confidence: of the best mined rule that fits."""
    u = F.col(url)
    rows = pages.select(F.col(id_col).alias("page_id"), u.alias("_url"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("_listed", listed(F.col("host"), F.col("path"), rules))
    few = mined.count()
    if few:
        index = F.broadcast(mined) if few <= BROADCAST_RULES else mined
        met = rows.where("_listed is null").select("_url", tokens_of(F.col("_url")).alias("_all")).distinct()
        met = met.select("_url", "_all", F.explode("_all").alias("token")).join(index, "token").where(F.forall("any_of", lambda tokens: F.arrays_overlap(tokens, F.col("_all"))))
        met = met.groupBy(F.col("_url").alias("_met")).agg(F.max("confidence").alias("confidence"))
        rows = rows.join(met, F.col("_url") == F.col("_met"), "left")
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce(F.col("_listed.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("_listed").isNull(), F.col("confidence")).alias("confidence"))


def label_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages with a label of their id; bad if any label says low quality or toxic."""
    bad = labels.groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    return pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id")).select("url", "bad")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the URL filter for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES, mine(label_pages(pages, table(spark, sf_dir, "labels"))))
