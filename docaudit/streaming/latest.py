"""Latest successful row by key from a log that keeps arriving.

State is a row a key; events that come again within the watermark are dropped. A batch read over the same rows gives
the same result (operators.state.latest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(log: DataFrame, time: str, ids: list[str], late: str = "1 day") -> DataFrame:
    return log.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def latest(log: DataFrame, by: list[str], order: list[str], ok: Column) -> DataFrame:
    rest = [c for c in log.columns if c not in by]
    top = log.where(ok).groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return top.select(*by, "_last.*")


def windowed_counts(log: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "1 day") -> DataFrame:
    return log.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))
