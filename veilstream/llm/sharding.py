"""Sharding by balanced label propagation, under the law `rows`: shard sizes differ by one row at most.

Documents of one group (here: equal texts) are linked. Groups that hold more than 1/64 of a shard, about a thousand
at most, are placed first, largest first: each whole where there is room for it, and one larger than a shard fills
whole shards and then the tightest room for what is left. Labels of the others start from a hash. In each round every
linked document wants the shard, of those with room, that most of its neighbours are in, and moves there as far as
that shard's quota of free rows goes; the moves that mend the most links come first. Groups that are still cut after
the rounds, or have no room, are laid along the free places of all shards in a row; the few that would lie across a
border are placed like the large ones. So a group is cut only if no shard has room for it then. Documents of one
group and shard are alike, so the state is a count per (group, shard), and no link is ever spelled out. Documents
without links then fill what is left of each shard, which makes the sizes even to a row.

Defined results: a null text is linked with nothing and has size 1 and checksum 0; an empty text is a text like
others. Rows that repeat a document are rows of their own, in the group of their text. Ties between shards and
between groups go by hash of the group. An empty table gives an empty result. Other columns pass through `shard_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, running_totals, table

SHARDS = 16
ROUNDS = 4
#: Rows that one bucket of a numbering holds, about.
BUCKET_ROWS = 4096
#: Groups of more than this part of a shard are placed one by one.
LARGE = 1 / 64


def _numbered(rows: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """Adds `name`: numbers from 0 within keys, gapless; no task orders more than one bucket of a key."""
    rows = rows.withColumns({"_b": F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(buckets)).cast("int"), "_one": F.lit(1).cast("long")})
    return running_totals(rows, keys, "_b", ["doc_id", "crc", "size"], "_one", name).drop("_b", "_one")


def _propagate(state: DataFrame, free: DataFrame, shards: int, buckets: int) -> DataFrame:
    """One round: state (g, shard, n) after the moves that the quotas free (shard, quota) allow."""
    group = Window.partitionBy("g")
    # a group's best shard is of those with room; where none has room it stays as it is
    state = state.join(F.broadcast(free), "shard")
    best = F.max(F.when(F.col("quota") > 0, F.struct(F.col("n"), F.xxhash64("g", "shard").alias("tie"), F.col("shard")))).over(group)
    wish = state.withColumn("_best", best).select("g", "shard", "n", F.coalesce("_best.shard", "shard").alias("to"), (F.coalesce("_best.n", "n") - F.col("n")).alias("gain")).withColumn("to", F.when(F.col("gain") < 0, F.col("shard")).otherwise(F.col("to"))).withColumn("gain", F.greatest(F.lit(0), "gain"))
    stay = wish.where("shard = to").select("g", "shard", "n")
    move = wish.where("shard != to").withColumn("_b", F.least(F.lit(1 << 20), F.lit(0) - F.least(F.floor(F.log2(F.col("gain") + 1)), F.lit(40))) * buckets + F.pmod(F.xxhash64("g"), F.lit(buckets)))
    move = running_totals(move.withColumnRenamed("shard", "from").withColumnRenamed("to", "shard"), ["shard"], "_b", [F.desc("gain"), "g", "from"], "n", "_before")
    move = move.join(F.broadcast(free), "shard").withColumn("_ok", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("_before"))))
    went = move.where("_ok > 0").select("g", "shard", F.col("_ok").alias("n"))
    kept = move.where("_ok < n").select("g", F.col("from").alias("shard"), (F.col("n") - F.col("_ok")).alias("n"))
    return stay.unionByName(went).unionByName(kept).groupBy("g", "shard").agg(F.sum("n").cast("long").alias("n"))


def _place(rooms: list[int], n: int) -> list[tuple[int, int]]:
    """(shard, rows) for a group of n rows, taken off rooms: the tightest room that holds it, or the fewest shards that do."""
    parts = []
    while n:
        fits = [s for s, room in enumerate(rooms) if room >= n]
        s = min(fits, key=lambda s: (rooms[s], s)) if fits else max(range(len(rooms)), key=lambda s: (rooms[s], -s))
        k = min(n, rooms[s])
        rooms[s] -= k
        n -= k
        parts.append((s, k))
    return parts


def _ranges(rooms: list[int], at: str):
    """An array column's structs (_from, _to, shard): the places of all shards in a row."""
    out, start = [], 0
    for s, room in enumerate(rooms):
        out.append(F.struct(F.lit(start).cast("long").alias("_from"), F.lit(start + room).cast("long").alias("_to"), F.lit(s).alias("shard")))
        start += room
    return F.get(F.filter(F.array(*out), lambda x: (F.col(at) >= x["_from"]) & (F.col(at) < x["_to"])), F.lit(0))


def _gathered(state: DataFrame, rooms: list[int], buckets: int) -> DataFrame:
    """state (g, shard, n) with every group whole in a shard that has room for it, or cut where none has."""
    spark = state.sparkSession
    sums = state.groupBy("g").agg(F.count(F.lit(1)).alias("_in"), F.min("shard").alias("shard"), F.sum("n").cast("long").alias("n"))
    caps = spark.createDataFrame(list(enumerate(rooms)), "shard int, cap long")
    hashed = lambda df: df.withColumn("_b", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    whole = running_totals(hashed(sums.where("_in = 1")), ["shard"], "_b", ["g"], "n", "_before").join(F.broadcast(caps), "shard")
    whole = materialize(whole.where("_before + n <= cap").select("g", "shard", "n"), "shard-whole")
    loose = materialize(sums.join(whole.select("g"), "g", "left_anti").select("g", "n"), "shard-loose")

    def left(placed, rooms):
        has = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        return [room - has.get(s, 0) for s, room in enumerate(rooms)]

    rooms = left(whole, rooms)
    laid = running_totals(hashed(loose), [], "_b", ["g"], "n", "_before").withColumn("_at", _ranges(rooms, "_before"))
    laid = materialize(laid.select("g", "n", F.when(F.col("_before") + F.col("n") <= F.col("_at._to"), F.col("_at.shard")).alias("shard")), "shard-laid")
    put = laid.where("shard is not null").select("g", "shard", "n")
    rooms = left(put, rooms)
    # one group a border at most
    across = sorted(((r["n"], r["g"]) for r in laid.where("shard is null").collect()), reverse=True)
    rest = [(g, s, k) for n, g in across for s, k in _place(rooms, n)]
    return whole.unionByName(put).unionByName(spark.createDataFrame(rest, "g long, shard int, n long"))


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, group) for every row of docs."""
    t = F.col(text)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.encode(t, "UTF-8")), F.lit(0)).cast("long").alias("crc"), F.when(t.isNotNull(), F.xxhash64(t, F.octet_length(t), F.crc32(F.encode(t, "UTF-8")))).alias("g"))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    buckets = max(64, -(-total // BUCKET_ROWS))
    spark = rows.sparkSession
    rooms = [total // shards + (s < total % shards) for s in range(shards)]
    caps = spark.createDataFrame(list(enumerate(rooms)), "shard int, cap long")
    many = materialize(rows.where("g is not null").groupBy("g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "shard-groups")
    large = F.col("_n") > int(rooms[0] * LARGE)
    fixed = sorted(((r["_n"], r["g"]) for r in many.where(large).collect()), reverse=True)
    fixed = spark.createDataFrame([(g, s, k) for n, g in fixed for s, k in _place(rooms, n)], "g long, shard int, n long")
    open_ = F.array(*(F.lit(s) for s in range(shards) if rooms[s] or not any(rooms)))
    first = F.get(open_, F.pmod(F.xxhash64("doc_id"), F.size(open_)).cast("int"))
    rows = rows.join(many.select("g", F.lit(True).alias("_linked"), (~large).alias("_small")), "g", "left").withColumn("_linked", F.coalesce("_linked", F.lit(False)))
    linked = rows.where("_linked")
    state = materialize(linked.where("_small").groupBy("g", first.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "shard-labels")
    room = spark.createDataFrame(list(enumerate(rooms)), "shard int, cap long")
    for _ in range(rounds):
        # shards x 1 rows: the quota is what a shard's cap leaves beside the linked rows that it has
        free = room.join(state.groupBy("shard").agg(F.sum("n").alias("_has")), "shard", "left").select("shard", F.greatest(F.lit(0), F.col("cap") - F.coalesce("_has", F.lit(0))).alias("quota"))
        after = materialize(_propagate(state, free, shards, buckets), "shard-labels")
        still = after.exceptAll(state).isEmpty()
        state = after
        if still:
            break
    state = materialize(_gathered(state, rooms, buckets).unionByName(fixed), "shard-labels")
    upto = Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = state.withColumn("_to", F.sum("n").over(upto)).select(F.col("g").alias("_g"), F.col("shard"), (F.col("_to") - F.col("n")).alias("_from"), "_to")
    ranked = _numbered(linked, ["g"], buckets, "_k")
    placed = ranked.join(spans.groupBy("_g").agg(F.collect_list(F.struct("_from", "_to", "shard")).alias("_spans")), F.col("g") == F.col("_g"))
    placed = placed.withColumn("shard", F.get(F.filter("_spans", lambda x: (F.col("_k") >= x["_from"]) & (F.col("_k") < x["_to"])), F.lit(0))["shard"])
    placed = materialize(placed.select("doc_id", "size", "crc", "g", "shard"), "shard-linked")
    left = caps.join(placed.where("shard is not null").groupBy("shard").agg(F.count(F.lit(1)).alias("_has")), "shard", "left").withColumn("_left", F.col("cap") - F.coalesce("_has", F.lit(0)))
    # one row a shard: the driver reads how many places each has left
    places = [x["_left"] for x in sorted(left.select("shard", "_left").collect())]
    rest = rows.where("not _linked").select("doc_id", "size", "crc", F.lit(None).cast("long").alias("g")).unionByName(placed.where("shard is null").drop("shard"))
    rest = _numbered(rest, [], buckets, "_k")
    rest = rest.withColumn("shard", _ranges(places, "_k")["shard"])
    out = placed.where("shard is not null").unionByName(rest.select("doc_id", "size", "crc", "g", "shard"))
    return _numbered(out, ["shard"], buckets, "slot").select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.col("g").alias("group"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the sharding of all documents."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
