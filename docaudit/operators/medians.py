"""Exact medians of groups of any size: small groups at once, huge ones by histograms that close in on the middle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a group that one task may hold, and how many groups may have more: their number bounds what is broadcast.
HELD, HUGE_GROUPS = 1 << 16, 100_000
BINS = 1024


def _real(c: Column) -> Column:
    """NaN counts as missing."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def _same(by: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])


def selected(rows: DataFrame, by: list[str], value: Column, groups: list[T.Row], bins: int = BINS) -> list[tuple]:
    """(group's keys, median) of the given groups, each with its keys, n, least and most value. A pass counts values by
    bins between two bounds; the bin of the middle gives the next bounds. Tasks hold counts of bins only."""
    spark, keys = rows.sparkSession, rows.select(*by).schema
    kinds = T.StructType([T.StructField(f"_{f.name}", f.dataType) for f in keys] + [T.StructField("_low", T.LongType()), T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType()), T.StructField("_skip", T.LongType())])
    state = {tuple(g[c] for c in by): (g.n, g.least, g.most, 0) for g in groups}
    done: list[tuple] = []
    while state:
        for k, (_, a, b, _) in list(state.items()):
            if a == b:
                done.append((*k, a))
                del state[k]
        if not state:
            break
        bounds = spark.createDataFrame([(*k, (n - 1) // 2, a, b, skip) for k, (n, a, b, skip) in state.items()], kinds)
        v = rows.select(*by, _real(value).alias("_v")).join(F.broadcast(bounds), _same(by)).where(F.col("_v").between(F.col("_a"), F.col("_b")))
        half = lambda c: F.col(c) * 0.5  # noqa: E731  so that no difference overflows
        at = F.least(F.floor((half("_v") - half("_a")) / (half("_b") - half("_a")) * bins), F.lit(bins - 1))
        keys_ = [f"_{c}" for c in by]
        bars = v.groupBy(*keys_, "_low", "_skip", at.alias("_at")).agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        end = F.sum("c").over(Window.partitionBy(*keys_).orderBy("_at")) + F.col("_skip")
        bars = bars.withColumn("end", end)
        found: dict[tuple, dict[int, T.Row]] = {}
        for rank in (0, 1):
            want = F.col("_low") + rank
            for r in bars.where((want < F.col("end")) & (want >= F.col("end") - F.col("c"))).collect():
                found.setdefault(tuple(r[c] for c in keys_), {})[rank] = r
        for k, (n, *_) in list(state.items()):
            low, high = found[k][0], found[k].get(1)
            if n % 2:  # the middle value alone
                high = low
            if low["_at"] != high["_at"]:  # so one is the last of its bin, the other the first of the next
                done.append((*k, (low.hi + high.lo) / 2))
                del state[k]
            else:
                state[k] = (n, low.lo, low.hi, low.end - low.c)
    return done


def group_medians(rows: DataFrame, by: list[str], values: dict[str, Column], held: int = HELD, bins: int = BINS) -> DataFrame:
    """Exact medians of each group, null values and NaN apart. Groups of more than `held` rows, or more than that share of all
    rows that HUGE_GROUPS can have, are never gathered."""
    named = {f"_m{i}": _real(c) for i, c in enumerate(values.values())}
    narrow = rows.select(*by, *(c.alias(k) for k, c in named.items()))
    limit = max(held, narrow.count() // HUGE_GROUPS)
    huge = {}
    for k in named:
        sizes = narrow.groupBy(*by).agg(F.count(k).alias("n"), F.min(k).alias("least"), F.max(k).alias("most"))
        huge[k] = sizes.where(F.col("n") > limit).collect()
    out = None
    for k, name in zip(named, values, strict=True):
        small, large = narrow, None
        if huge[k]:
            found = selected(narrow, by, F.col(k), huge[k], bins)
            fields = list(narrow.select(*by).schema) + [T.StructField(name, T.DoubleType())]
            large = rows.sparkSession.createDataFrame(found, T.StructType(fields))
            names = F.broadcast(large.select(*(F.col(c).alias(f"_{c}") for c in by)))
            small = narrow.join(names, _same(by), "left_anti")
        one = small.groupBy(*by).agg(F.percentile(k, 0.5).alias(name))
        one = one if large is None else one.unionByName(large)
        if out is None:
            out = one
        else:
            other = one.select(*(F.col(c).alias(f"_{c}") for c in by), name)
            out = out.join(other, _same(by)).drop(*(f"_{c}" for c in by))
    return out
