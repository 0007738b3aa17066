"""Rules over ordered rows: islands, neighbours, sliding frames, positions, labels. Windows only.

Each takes the columns that partition and order the rows; an order that isn't total is completed by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], order: list) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def islands(rows: DataFrame, by: list[str], order: list, value: Column) -> DataFrame:
    """Adds `island`, the number of the run of equal values that a row is in (nulls are values)."""
    w = _w(by, order)
    before, first = F.lag(value).over(w), F.row_number().over(w) == 1
    rows = rows.withColumn("_new", F.when(first | ~value.eqNullSafe(before), 1).otherwise(0))
    return rows.withColumn("island", F.sum("_new").over(w)).drop("_new")


def split_values(rows: DataFrame, by: list[str], order: list, value: str) -> DataFrame:
    """Values that come in two or more runs that aren't next to each other, with their number of runs."""
    runs = islands(rows, by, order, F.col(value)).groupBy(*by, value, "island").count()
    return runs.groupBy(*by, value).agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")


def same_as_before(rows: DataFrame, by: list[str], order: list, value: str, distance: int = 1) -> DataFrame:
    """Rows whose value is that of the row `distance` before."""
    return rows.withColumn("_before", F.lag(value, distance).over(_w(by, order))).where(F.col(value) == F.col("_before")).drop("_before")


def with_size(rows: DataFrame, by: list[str], name: str = "n_rows") -> DataFrame:
    return rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*by)))


def over_quota(rows: DataFrame, by: list[str], value: str, least: int, share: float) -> DataFrame:
    """Values used more often than max(least, ceil(rows * share)); counted twice by key, never gathered."""
    used = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("used"))
    total = Window.partitionBy(*by)
    used = used.withColumn("n_rows", F.sum("used").over(total))
    return used.withColumn("quota", F.greatest(F.lit(least), F.ceil(F.col("n_rows") * share)).cast("long")).where(F.col(value).isNotNull() & (F.col("used") > F.col("quota")))


def frames_of(rows: DataFrame, by: list[str], order: list, flag: Column, size: int) -> DataFrame:
    """The first row of every frame of `size` rows in all of which the flag holds."""
    frame = _w(by, order).rowsBetween(0, size - 1)
    rows = rows.withColumn("_all", F.bool_and(F.coalesce(flag, F.lit(False))).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame))
    return rows.where(F.col("_all") & (F.col("_n") == size)).drop("_all", "_n")


def first_frame(rows: DataFrame, by: list[str], order: list, flag: Column, size: int) -> DataFrame:
    """The first of those frames in each partition."""
    found = frames_of(rows, by, order, flag, size)
    return found.withColumn("_rank", F.row_number().over(_w(by, order))).where("_rank = 1").drop("_rank")


def long_runs(rows: DataFrame, by: list[str], order: list, flag: Column, more_than: int) -> DataFrame:
    """Runs of over `more_than` rows in which the flag holds: island, n, and what starts them by order."""
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_at", F.row_number().over(_w(by, order)))
    runs = islands(rows, by, [F.col("_at")], F.col("_flag")).where("_flag")
    return runs.groupBy(*by, "island").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("starts_at")).where(F.col("n") > more_than)


def next_where(rows: DataFrame, by: list[str], order: list, value: Column, holds: Column) -> Column:
    """The value of the next row after this one for which the condition holds."""
    return F.first(F.when(holds, value), ignorenulls=True).over(_w(by, order).rowsBetween(1, Window.unboundedFollowing))


def labels(rows: DataFrame, by: list[str], order: list, kind: Column, skip_first: bool = True, skip_last: bool = True) -> DataFrame:
    """Adds `label`: A1, A2 ... for appendix rows, else the two-digit position; '' for the first and the closing row."""
    w, every = _w(by, order), Window.partitionBy(*by)
    n, appendix = F.row_number().over(w), F.sum(F.when(kind == "appendix", 1).otherwise(0)).over(w)
    closing = F.coalesce(F.max(F.when(kind == "closing", 1)).over(every), F.lit(0)) > 0
    last = F.when(closing, F.coalesce(kind == "closing", F.lit(False))).otherwise(n == F.count(F.lit(1)).over(every))
    label = F.when((n == 1) & F.lit(skip_first), "").when(last & F.lit(skip_last), "").when(kind == "appendix", F.concat(F.lit("A"), appendix.cast("string"))).otherwise(F.format_string("%02d", n))
    return rows.withColumn("label", label)


def misplaced_tail(rows: DataFrame, by: list[str], order: list, is_tail: Column, is_end: Column) -> DataFrame:
    """For partitions with tail rows: whether the end row comes after the tail began, and whether others follow in the tail."""
    w = _w(by, order)
    rows = rows.withColumn("_at", F.row_number().over(w)).withColumn("_tail", F.coalesce(is_tail, F.lit(False))).withColumn("_end", F.coalesce(is_end, F.lit(False)))
    first = F.min(F.when(F.col("_tail"), F.col("_at"))).over(Window.partitionBy(*by))
    rows = rows.withColumn("_first", first).where("_first IS NOT NULL")
    end = F.min(F.when(F.col("_end"), F.col("_at")))
    return rows.groupBy(*by, "_first").agg((end > F.col("_first")).alias("end_after_tail"), F.bool_or((F.col("_at") >= F.col("_first")) & ~F.col("_tail")).alias("broken")).drop("_first").na.fill(False, ["end_after_tail"])


def top_per_group(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank and how many others the group has."""
    ranked = rows.withColumn("rank", F.row_number().over(_w(by, order))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return ranked.where(F.col("rank") <= k).withColumn("others", F.greatest(F.col("_n") - k, F.lit(0))).drop("_n")


def next_free(rows: DataFrame, by: list[str], version: str) -> DataFrame:
    """The least version from 1 that a group doesn't use: versions in order equal their rank until the first gap."""
    used = rows.where(F.col(version) >= 1).select(*by, version).distinct()
    dense = used.withColumn("_rank", F.row_number().over(_w(by, [version])))
    full = dense.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_rank") == F.col(version), F.col(version))), F.lit(0)).alias("_full"))
    return full.select(*by, (F.col("_full") + 1).cast("long").alias("next_free"))
