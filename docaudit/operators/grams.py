"""Lines and entries that share many character n-grams: an index of the entries' grams, asked with a line's rarest ones.

A line of m places for grams needs max(1, floor(share * m)) distinct ones in common with an entry. Grams are 64-bit numbers, made
for a whole batch of lines at once. Of a line's distinct grams those stay that some entry has; with fewer than it
needs the line is out. The rest are put in order of how many entries have them, and a line with v of them only asks the
index for the first v - need + 1: an entry that shares enough shares one of these. What is found is counted in full.
An index that all tasks can hold needs no such filter: each line's grams are counted against it where the line is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grams of entries that are sent to all tasks at most (16 bytes each); more are joined by shuffle.
SENT = 1 << 22
#: Entries that a block of lines is counted against at once, each time one of them has a gram; one line may have more, SENT at most.
LOOKED_AT = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed odd number of a mixing step


def window_numbers(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which text, number) of every window of n characters of some texts. Up to three characters are a number as they are."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = np.zeros(m, np.uint64)
    for i in range(n):
        c = codes[i : i + m]
        x = (x << np.uint64(21)) | c if n <= 3 else (x ^ (x >> np.uint64(29)) ^ c) * _ODD
    x ^= x >> np.uint64(32) if n > 3 else np.uint64(0)
    inside = owner[:m] == owner[n - 1 :]
    return owner[:m][inside], x[inside].view(np.int64)


def distinct_numbers(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats within a text, in order of text and number."""
    owner, x = window_numbers(texts, n)
    order = np.lexsort((x, owner))
    owner, x = owner[order], x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (x[1:] != x[:-1])
    return owner[fresh], x[fresh]


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _pieces(batches: Iterable[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of about so many bytes, or one row."""
    for b in batches:
        rows = max(1, int(b.num_rows * limit / max(limit, b.nbytes)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def gram_lists(rows: DataFrame, key: str, column: str, n: int) -> DataFrame:
    """(key, m, grams): the places for grams of each text, and its distinct grams. Null texts have none."""
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            owner, x = distinct_numbers(texts, n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) - n + 1 for t in texts], pa.int32()), _lists(owner, x, len(texts), pa.int64())], [key, "m", "grams"])

    return rows.select(key, column).mapInArrow(run, f"{key} {kind}, m int, grams array<long>")


def _needed(share: float):
    return F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("m"))).cast("int")


def known_grams(lines: DataFrame, entries: DataFrame, n: int, share: float, sent: int = SENT) -> DataFrame:
    """(line_id, need, grams): lines with enough grams that some entry has, rarest first. entries: entry_id, grams."""
    counts = entries.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("df"))
    counts = counts.cache()
    try:
        if counts.count() > sent:
            each = gram_lists(lines, "line_id", "line", n).select("line_id", _needed(share).alias("need"), F.explode("grams").alias("g")).join(counts, "g")
            found = each.groupBy("line_id", "need").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
            return found.where(F.size("gs") >= F.col("need")).select("line_id", "need", F.transform("gs", lambda s: s.g).alias("grams"))
        table = counts.toArrow()
    finally:
        counts.unpersist()
    g, df = table["g"].to_numpy(), table["df"].to_numpy()
    order = np.argsort(g)
    shared = lines.sparkSession.sparkContext.broadcast((g[order], df[order]))
    kind = lines.select("line_id").schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, df = shared.value
        for b in _pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            need = np.maximum(1, np.floor(share * np.array([len(t) - n + 1 for t in texts], float))).astype(np.int32)
            owner, x = distinct_numbers(texts, n)
            at = np.minimum(np.searchsorted(g, x), max(0, len(g) - 1))
            hit = g[at] == x if len(g) else np.zeros(len(x), bool)
            owner, x, at = owner[hit], x[hit], at[hit]
            stays = np.bincount(owner, minlength=len(texts)) >= need
            owner, x, at = owner[stays[owner]], x[stays[owner]], at[stays[owner]]
            order = np.lexsort((x, df[at], owner))
            rows = np.flatnonzero(stays)
            place = np.searchsorted(rows, owner[order])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(need[rows]), _lists(place, x[order], len(rows), pa.int64())], ["line_id", "need", "grams"])

    return lines.select("line_id", "line").mapInArrow(run, f"line_id {kind}, need int, grams array<long>")


def counted(lines: DataFrame, index: DataFrame, n: int, share: float) -> DataFrame:
    """(line_id, entry_id, n_shared) by an index that is sent to all tasks: what a block of lines shares with all entries is counted
    where the lines are, so no pair is shuffled that doesn't share enough. index: entry_id, grams."""
    table = index.where("entry_id IS NOT NULL").toArrow().combine_chunks()
    lists, ids = table["grams"].combine_chunks(), table["entry_id"].combine_chunks()
    owner, flat = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    order = np.argsort(flat, kind="stable")
    g, begin = np.unique(flat[order], return_index=True)
    shared = lines.sparkSession.sparkContext.broadcast((g, np.append(begin, len(flat)), owner[order], ids))
    line_kind, entry_kind = lines.schema["line_id"].dataType.simpleString(), index.schema["entry_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, begin, entry, ids = shared.value
        for b in _pieces(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            need = np.maximum(1, np.floor(share * np.array([len(t) - n + 1 for t in texts], float))).astype(np.int64)
            owner, x = distinct_numbers(texts, n)
            at = np.minimum(np.searchsorted(g, x), max(0, len(g) - 1))
            hit = g[at] == x if len(g) else np.zeros(len(x), bool)
            owner, at = owner[hit], at[hit]
            stays = np.bincount(owner, minlength=len(texts)) >= need
            owner, at = owner[stays[owner]], at[stays[owner]]
            times = begin[at + 1] - begin[at]
            total = np.cumsum(np.bincount(owner, times, len(texts)))  # entries to look at, up to each line
            low = 0
            while low < len(texts):
                done = total[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(total, done + LOOKED_AT, "right")))
                mine = slice(*np.searchsorted(owner, [low, high]))
                t, first = times[mine], begin[at[mine]]
                ends = np.cumsum(t)
                spots = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + t, t)
                pairs, n_shared = np.unique(np.repeat(owner[mine], t) * np.int64(len(ids)) + entry[spots], return_counts=True)
                line, e = np.divmod(pairs, max(1, len(ids)))
                ok = n_shared >= need[line]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(line[ok])), ids.take(pa.array(e[ok])), pa.array(n_shared[ok], pa.int64())], ["line_id", "entry_id", "n_shared"])
                low = high

    return lines.select("line_id", "line").mapInArrow(run, f"line_id {line_kind}, entry_id {entry_kind}, n_shared long")


def sharing(lines: DataFrame, entries: DataFrame, n: int, share: float, sent: int = SENT) -> DataFrame:
    """(line_id, entry_id, n_shared): all pairs that share enough. lines: line_id, line; entries: entry_id, entry. An index of up to
    `sent` rows is sent to the tasks, a larger one is asked by shuffle, with a line's rarest grams."""
    index = gram_lists(entries, "entry_id", "entry", n).select("entry_id", "grams")
    if (index.agg(F.sum(F.size("grams"))).first()[0] or 0) <= sent:
        return counted(lines.where("line_id IS NOT NULL"), index, n, share)
    asked = known_grams(lines, index, n, share, sent)
    first = F.explode(F.slice("grams", F.lit(1), F.size("grams") - F.col("need") + 1)).alias("g")
    near = asked.select("line_id", first).join(index.select("entry_id", F.explode("grams").alias("g")), "g").select("line_id", "entry_id").distinct()
    both = near.join(asked, "line_id").join(index.withColumnRenamed("grams", "theirs"), "entry_id")
    n_shared = F.size(F.array_intersect("grams", "theirs")).cast("long")
    return both.withColumn("n_shared", n_shared).where(F.col("n_shared") >= F.col("need")).select("line_id", "entry_id", "n_shared")
