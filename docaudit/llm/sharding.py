"""Sharding by a Feistel permutation with cycle walking over global row numbers. DataFrame functions only.

Every row gets a global number (ordered by bucket of a hash, then id, checksum and size), a keyed permutation of
0..n-1 moves it, and shard and slot are the remainder and quotient of its new place by the number of shards. So
shard counts differ by at most one, slots have no gaps, a run can be repeated from the seed, and any (shard,
slot) is found without a table: `row_of` gives the number of the row that sits there.

Cases: null text counts as 0 bytes and checksum 0; null ids come first and are told apart by their text; equal
rows get numbers next to one another: they are counted before anything moves, and dealt out again in chunks, so no task
sees all of them; an empty table gives an empty result. Only id and text are read, so other columns' names don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows are numbered within so many hash buckets at once; the table of bucket offsets has a row for each at most.
BUCKETS = 4096
ROUNDS, WALKS, EXTRA_BYTES = 6, 64, 16
#: Equal rows that are dealt out by one task.
CHUNK = 1 << 16


def _div(x: Column, y: Column) -> Column:
    """Whole quotient of non-negative numbers, exact beyond 2^53."""
    return ((x - F.pmod(x, y)) / y).cast("long")


def _rounds(x: Column, a: Column, b: Column, seed: int, inverse: bool) -> Column:
    """One pass over the domain a * b >= n: the halves x div b and x mod b take turns, each shifted by a hash of the other."""

    def half(s: Column, k: Column) -> Column:
        by_right, by_left = (F.pmod(F.xxhash64(F.lit(seed), k, s[h]), m) for h, m in (("r", a), ("l", b)))
        left = F.struct(F.pmod(s.l - by_right if inverse else s.l + by_right, a).alias("l"), s.r.alias("r"))
        right = F.struct(s.l.alias("l"), F.pmod(s.r - by_left if inverse else s.r + by_left, b).alias("r"))
        return F.when(k % 2 == 0, left).otherwise(right)

    keys = list(range(ROUNDS))[:: -1 if inverse else 1]
    start = F.struct(_div(x, b).alias("l"), (x % b).alias("r"))
    return F.aggregate(F.array(*map(F.lit, keys)), start, half, lambda s: s.l * b + s.r)


def permuted(x: Column, n: Column, seed: int = 1, inverse: bool = False) -> Column:
    """The keyed permutation of 0..n-1, or its inverse. Places at n or above are walked on from; there are fewer
    than sqrt(n) of them, so a walk of over WALKS steps isn't met, and would be an error, not a wrong row."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = _div(n + a - 1, a)
    step = lambda v, i: F.when((i > 1) & (v < n), v).otherwise(_rounds(v, a, b, seed, inverse))
    end = lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk didn't end")).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, step, end)


def row_of(shard: Column, slot: Column, n: Column, shards: int, seed: int = 1) -> Column:
    """Number of the row that is in this slot of this shard."""
    return permuted(slot * shards + shard, n, seed, inverse=True)


def numbered(rows: DataFrame, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """Adds row_no (from 0, without gaps) and n_rows. Equal rows are counted first. The kinds of rows are summed up by
    hash bucket and numbered bucket by bucket: no task sees all rows, whatever their number or how many are equal."""
    names = rows.columns
    kinds = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    kinds = kinds.withColumn("bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)).cast("int"))
    w = Window.orderBy("bucket")
    starts = kinds.groupBy("bucket").agg(F.sum("copies").alias("n"))
    starts = starts.select("bucket", (F.sum("n").over(w) - F.col("n")).alias("start"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_rows"))
    inside = F.sum("copies").over(Window.partitionBy("bucket").orderBy(*(F.col(c).asc_nulls_first() for c in names))) - F.col("copies")
    # The side that is broadcast has a row for each bucket at most: 4096 rows of three numbers.
    kinds = kinds.withColumn("inside", inside).join(F.broadcast(starts), "bucket").withColumn("first", F.col("start") + F.col("inside"))
    few = kinds.where(F.col("copies") <= chunk).select(*names, "n_rows", "first", "copies")
    many = kinds.where(F.col("copies") > chunk).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long")))).repartition("first", "at")
    many = many.select(*names, "n_rows", (F.col("first") + F.col("at")).alias("first"), F.least(F.lit(chunk), F.col("copies") - F.col("at")).alias("copies"))
    return few.union(many).select(*names, "n_rows", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("row_no"))


def shard(docs: DataFrame, shards: int = 40, seed: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no: see the module's text."""
    rows = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + EXTRA_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    placed = numbered(rows.select(key, "text_crc32", "size")).withColumn("place", permuted(F.col("row_no"), F.col("n_rows"), seed))
    return placed.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        _div(F.col("place"), F.lit(shards)).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
