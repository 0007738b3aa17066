"""Writing what the engine finds: findings tables, change logs, Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_findings(findings: DataFrame, path: str) -> None:
    """Replaces the findings table, by rule, so that a reader of one rule reads one folder."""
    findings.write.mode("overwrite").partitionBy("rule").parquet(path)


def append_log(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_rows(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A line of a Markdown table for each row, in order; rendering stays with the reader, as it is at the edge."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns)), F.lit(" |"))
    return rows.orderBy(*order).select(line.alias("line"))


def side_by_side(rows: DataFrame, attribute: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Attributes by column: a pivot over a stated set of columns."""
    return rows.groupBy(attribute).pivot(column, columns).agg(F.first(value))
