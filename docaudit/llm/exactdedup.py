"""Exact dedup of arriving batches against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when they are identical after each run of white space (space, tab to carriage return) became one
space. A batch is first grouped by digest on its own. Its distinct digests then pass the fuse filters of every earlier
snapshot: what no filter knows is new and touches no snapshot; what a filter knows joins that snapshot's exact
bucket. Digests that are there, or twice in the batch, are candidates, and only their rows are compared byte by byte
(grouped by whole text). What was new becomes the batch's own snapshot, with its filters; snapshots never
change. `dedup` takes a table as batches in order of id and gives every row its group.

Distribution: rows are counted by digest before they move. Filters are made and probed by bucket of the digest's
hash, of about PER_FILTER digests. A digest with over 1/HEAVY of all rows is joined by broadcast (at most HEAVY a
batch), any other by shuffle. No filter, digest or group meets in the driver; it sees counts and two cut points.

Cases: null text is empty, and empty texts are equal to one another; null ids come after all others, and a group of null ids
has keep_id null; of rows with equal id and text one is kept; digests that agree
while texts differ are told apart by the byte check; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import Scratch

BATCHES, PER_FILTER, HEAVY = 3, 1 << 13, 10_000
#: Bytes of a checksum that serve as digest: in very large tables some digests of different texts agree.
WIDTH = 8
#: Equal rows that are written out by one task.
CHUNK = 1 << 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass(frozen=True)
class Snapshot:
    """entries: digest, key (its 64-bit hash), first_id; filters: bucket, filter, over the keys."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("key"), F.lit(buckets)).cast("int")


def _one_filter(bucket: tuple, rows: pa.Table) -> pa.Table:
    made = fuse.build(rows.column("key").to_numpy().view(np.uint64))
    return pa.table({"bucket": pa.array([bucket[0].as_py()], pa.int32()), "filter": pa.array([made], pa.binary())})


def snapshot(scratch: Scratch, entries: DataFrame, per_filter: int = PER_FILTER) -> Snapshot:
    """Writes entries (digest, first_id; digests are distinct) and their filters."""
    entries = scratch.write(entries.select("digest", F.xxhash64("digest").alias("key"), "first_id"))
    buckets = max(1, -(-entries.count() // per_filter))
    filters = entries.select("key", _bucket(buckets).alias("bucket")).groupBy("bucket").applyInArrow(_one_filter, "bucket int, filter binary")
    return Snapshot(entries, scratch.write(filters), buckets)


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    keys = rows.column("key").to_numpy().view(np.uint64)
    found = fuse.contains(filters.column("filter")[0].as_py() if filters.num_rows else None, keys)
    return rows.select(["digest", "key"]).filter(pa.array(found))


def screened(digests: DataFrame, n: int, snap: Snapshot, per_filter: int = PER_FILTER) -> DataFrame:
    """digest, key: those of n distinct digests that a filter of the snapshot knows. A bucket of the batch is cut in
    slices where the batch is larger than the snapshot."""
    slices = max(1, -(-n // (snap.buckets * per_filter)))
    part = F.pmod(F.shiftright("key", 32), F.lit(slices)).cast("int").alias("part")
    rows = digests.select("digest", "key", _bucket(snap.buckets).alias("bucket"), part)
    filters = snap.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return rows.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInArrow(_probe, "digest binary, key long")


def known(digests: DataFrame, n: int, snap: Snapshot, per_filter: int = PER_FILTER) -> DataFrame:
    """digest, first_id of the snapshot's entries that are among the digests: filters first, then exact buckets."""
    positives = screened(digests, n, snap, per_filter).select("digest")
    return snap.entries.join(positives, "digest", "left_semi").select("digest", "first_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _joined(rows: DataFrame, on: str, heavy: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """rows joined with other on a column: its heavy values by broadcast, which HEAVY bounds, all others by shuffle."""
    hot = rows.join(F.broadcast(other.join(F.broadcast(heavy), on, "left_semi")), on, "left_semi" if how == "left_semi" else "inner")
    return hot.unionByName(rows.join(F.broadcast(heavy), on, "left_anti").join(other, on, how))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, per_filter: int = PER_FILTER, width: int = WIDTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row. `width` is the number of a checksum's bytes
    that serve as digest."""
    scratch = Scratch(docs.sparkSession, "exactdedup")
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)]).alias("cuts")).first().cuts or []
    batch = reduce(lambda a, c: a + F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int"), cuts, F.lit(0))
    sha = F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256))
    marks = docs.select("doc_id", sha.alias("sha"), batch.alias("batch")).groupBy("doc_id", "sha", "batch").agg(F.count(F.lit(1)).alias("copies"))
    marks = scratch.write(marks)
    total = marks.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n

    snaps: list[Snapshot] = []
    arrived, suspects = [], []
    for b in range(batches):
        fresh = marks.where(F.col("batch") == b).groupBy(F.substring("sha", 1, width).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.sum("copies").alias("n"))
        fresh = scratch.write(fresh.withColumn("key", F.xxhash64("digest")))
        arrived.append(fresh)
        suspects.append(fresh.where("n > 1").select("digest"))
        n, new = fresh.count(), fresh
        if snaps:
            seen = scratch.write(_union([known(fresh, n, s, per_filter).select("digest") for s in snaps]))
            suspects.append(seen)
            new = fresh.join(seen, "digest", "left_anti")
        if b < batches - 1:  # nothing arrives after the last one
            snaps.append(snapshot(scratch, new, per_filter))

    candidates = scratch.write(_union(suspects).distinct())
    heavy = scratch.write(_union([f.where(F.col("n") * HEAVY > total).select("digest") for f in arrived]).distinct())
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("sha", F.unhex(F.sha2(F.encode("norm", "UTF-8"), 256)))
    rows = _joined(rows.withColumn("digest", F.substring("sha", 1, width)), "digest", heavy, candidates, "left_semi")
    # The byte check: the whole text is a grouping key, and rows are counted before they move.
    alike = rows.groupBy("sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    alike = scratch.write(alike.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    one = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long"))
    groups = alike.select("sha", "keep_id", one.alias("group_size"))
    heavy = scratch.write(groups.where(F.col("group_size") * HEAVY > total).select("sha"))
    out = _written_out(_joined(marks, "sha", heavy, groups, "left"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _written_out(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each copy; the first of the rows with the kept id is the one that stays."""
    rows = rows.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    rows = rows.withColumn("group_size", F.coalesce("group_size", "copies")).withColumn("at", F.lit(0).cast("long"))
    few = rows.where(F.col("copies") <= chunk)
    many = rows.where(F.col("copies") > chunk).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))))
    many = many.withColumn("copies", F.least(F.lit(chunk), F.col("copies") - F.col("at"))).repartition("sha", "at")
    rows = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("copies") - 1)))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0))


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size,
  doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM k
"""
