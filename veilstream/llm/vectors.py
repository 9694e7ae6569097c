"""Vector code compression: product codes whose nearest entries are found by slicing and intersecting bit masks.

A vector's components become integers, its parts get a codebook each, and a part is coded by the index of its nearest
entry. The nearest entry is found exactly without comparing all of them: in each dimension the entries' coordinates are
sorted, and beside each position stands the mask of the entries before it. A radius selects a range of positions in each
dimension, the exclusive or of the masks at its two ends is the set of entries in it, and the AND over all dimensions,
64 entries a word, is the set of entries within that radius in every dimension. An initial radius gives first candidates;
the best of them gives the final radius, in which every entry at least as near must lie.

Spark deals out the vectors. A round sums the parts of each entry within the task, then over tasks; only codebooks (at
most 256 entries of the vectors' dimension) go to the driver and back.

Defined results: a vector that is null or holds a null, NaN or infinite component is left out. The dimension is that of
the longest vector, raised to a multiple of the number of parts; shorter vectors are filled up with 0, empty ones too.
Integers beyond +-2^28 count as +-2^28, so that distances fit in 64 bits. A null id is an id like others and comes after
them; rows that share an id count each, ordered by their vectors. Fewer rows than entries make a shorter codebook. Equal
vectors get equal codes. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Parts of a vector, entries of a part's codebook (an index must fit in two hex digits), rounds, integers in 1.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are kept within this.
MOST = 1 << 28
#: Parts that are compared at a time.
CHUNK = 512


def kept_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, v array<double>) of the vectors that count."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(v.isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v"))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """(n, width) integers floor(SCALE * x) of a column of lists, filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.clip(np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE), -MOST, MOST).astype(np.int64)
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Slices:
    """A codebook of one part: for each dimension the sorted coordinates, with a mask of the entries before each position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, self.words = len(entries), -(-len(entries) // 64)
        bits = np.zeros((k, self.words), np.uint64)
        bits[np.arange(k), np.arange(k) // 64] = np.uint64(1) << (np.arange(k) % 64).astype(np.uint64)
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, d], d] for d in range(entries.shape[1])]
        start = np.zeros((1, self.words), np.uint64)
        self.before = [np.concatenate((start, np.bitwise_or.accumulate(bits[order[:, d]], axis=0))) for d in range(entries.shape[1])]
        self.all = np.bitwise_or.reduce(bits, axis=0)
        far = np.zeros((k, k), np.int64)
        for d in range(entries.shape[1]):
            np.maximum(far, np.abs(entries[:, None, d] - entries[None, :, d]), out=far)
        np.fill_diagonal(far, np.iinfo(np.int64).max)
        #: Initial radius: half the entries have another one within it.
        self.radius = max(1, int(np.median(far.min(axis=1)))) if k > 1 else 1

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(n, words) masks of the entries within radius of each part in every dimension."""
        found = np.broadcast_to(self.all, (len(parts), self.words)).copy()
        for d, (line, before) in enumerate(zip(self.sorted, self.before)):
            low, high = np.searchsorted(line, parts[:, d] - radius, "left"), np.searchsorted(line, parts[:, d] + radius, "right")
            found &= before[high] ^ before[low]
        return found

    def best(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry in each mask, the lowest index among equals; none may be empty."""
        bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")
        rows, cols = np.nonzero(bits)
        apart = parts[rows] - self.entries[cols]
        distance = np.einsum("ij,ij->i", apart, apart)
        many = np.bincount(rows, minlength=len(parts))
        least = np.minimum.reduceat(distance, np.cumsum(many) - many)
        hits = np.flatnonzero(distance == np.repeat(least, many))
        return cols[hits[np.unique(rows[hits], return_index=True)[1]]], least

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        radius = np.full(len(parts), self.radius, np.int64)
        masks = self.within(parts, radius)
        while len(none := np.flatnonzero(~masks.any(axis=1))):
            radius[none] *= 2
            masks[none] = self.within(parts[none], radius[none])
        index, distance = self.best(parts, masks)
        # an entry at that distance or less is within its root in each dimension
        root = np.sqrt(distance.astype(np.float64)).astype(np.int64)
        root += (root + 1) ** 2 <= distance
        root -= root**2 > distance
        wide = np.flatnonzero(root > radius)
        if len(wide):
            more = self.within(parts[wide], root[wide]) & ~masks[wide]
            wide, more = wide[more.any(axis=1)], more[more.any(axis=1)]
        if len(wide):
            other, at = self.best(parts[wide], more)
            nearer = (at < distance[wide]) | ((at == distance[wide]) & (other < index[wide]))
            index[wide[nearer]], distance[wide[nearer]] = other[nearer], at[nearer]
        return index, distance


def assigned(values: np.ndarray, books: list[Slices]) -> tuple[np.ndarray, np.ndarray]:
    """((n, parts) indexes, (n, parts) squared distances)."""
    n, width = len(values), values.shape[1] // len(books)
    index, distance = np.zeros((n, len(books)), np.int64), np.zeros((n, len(books)), np.int64)
    for p, book in enumerate(books):
        for at in range(0, n, CHUNK):
            index[at : at + CHUNK, p], distance[at : at + CHUNK, p] = book.nearest(values[at : at + CHUNK, p * width : (p + 1) * width])
    return index, distance


def start(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids."""
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"]
    width = -(-longest // parts)
    return integers(first, parts * width).reshape(len(first), parts, width).transpose(1, 0, 2)


def refine(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one more round: each entry the floor of its parts' mean; those without parts stay."""
    parts, entries, width = books.shape
    if not width or not entries:
        return books

    def sums(batches):
        slices = [Slices(b) for b in books]
        total, many = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            values = integers(batch.column("v"), parts * width)
            for p, codes in enumerate(assigned(values, slices)[0].T):
                if len(codes):
                    order = np.argsort(codes, kind="stable")
                    held, begin = np.unique(codes[order], return_index=True)
                    total[p, held] += np.add.reduceat(values[order, p * width : (p + 1) * width], begin, axis=0)
                    many[p] += np.bincount(codes, minlength=entries)
        p, e = np.nonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(many[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    per_task = kept.select("v").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
    # the result has a row for each entry of the codebooks at most
    rows = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")) for d in range(width))).alias("sums")).collect()
    books = books.copy()
    for r in rows:
        books[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return books


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of integers after the given rounds over all vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an index must fit in two hex digits")
    books = start(kept, parts, entries)
    for _ in range(rounds):
        books = refine(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances summed over parts."""
    parts, entries, width = books.shape
    id_type, label_type = kept.schema["vec_id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()

    def code(batches):
        slices = [Slices(b) for b in books] if width and entries else []
        for batch in batches:
            if slices:
                index, distance = assigned(integers(batch.column("v"), parts * width), slices)
            else:
                index = distance = np.zeros((batch.num_rows, parts), np.int64)
            codes = [row.tobytes().hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(code, f"vec_id {id_type}, label {label_type}, code string, error long")


def decode(code: Column, books: np.ndarray) -> Column:
    """The vector (array<double>) that a code stands for."""
    entries = F.array(*(F.array(*(F.array(*(F.lit(float(x) / SCALE) for x in e)) for e in book)) for book in books))
    at = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.flatten(F.array(*(F.get(F.get(entries, F.lit(p)), at(p)) for p in range(len(books)))))


def digest(books: np.ndarray) -> str:
    """Lowercase hex sha256 of all components, by part, entry and position, parted by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(codes, codebooks): codes (vec_id, label, code, error) of all vectors that count."""
    kept = kept_vectors(vectors, vec_id, vector, label)
    books = fit(kept, parts, entries, rounds)
    return encode(kept, books), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Contract columns of all embeddings."""
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    codes = materialize(codes, "vector-codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    assign = """select p, vec_id, label, x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::bigint, e := e)) best from parts join c{0} using (p) group by all"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} as materialized ({assign.format(r)})")
        steps.append(f"""s{r} as (select p, e, k, sum(y)::bigint s, count(*) n from (select p, best.e e, unnest(x) y, generate_subscripts(x, 1) k from a{r}) group by all)""")
        steps.append(f"""c{r + 1} as materialized (select o.p, o.e, coalesce(w.c, o.c) c from c{r} o left join (select p, e, list((s - ((s % n) + n) % n) // n order by k) c from s{r} group by all) w using (p, e))""")
    return f"""
    with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    parts as materialized (select vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] x from kept, range({PARTS}) t(p)),
    c0 as materialized (select p, e, x c from (select p, x, row_number() over (partition by p order by vec_id) - 1 e from parts) where e < {ENTRIES}),
    {", ".join(steps)},
    last as ({assign.format(rounds)}),
    codes as materialized (select vec_id, label, string_agg(printf('%02x', best.e), '' order by p) code, sum(best.d)::bigint error from last group by all)
    select vec_id, code, error, sum(error) over (partition by label)::bigint label_error,
      (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from c{rounds}) codebooks_sha256 from codes
    """


OP13_SQL = _sql()

__all__ = ["OP13_SQL", "compress", "decode", "digest", "encode", "fit", "kept_vectors", "op13_vector_codes"]
