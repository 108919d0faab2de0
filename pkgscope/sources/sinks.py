"""Sinks: partitioned tables, tables published whole, JSON and Markdown reports.

Spark commits a write when its job ends, so a lost task or executor leaves nothing behind that a reader could take for data.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folders

DASH = "—"


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes df by partitions and replaces just those it has rows for; a second run with the same rows changes nothing."""
    df.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def publish(df: DataFrame, path: str) -> None:
    """Writes df beside path and puts it in place when it is complete; until then readers see the table that was there.

    df may be made from that table. On a store without renames the last step copies; a driver lost between its two renames leaves the new
    table beside the path under a name that begins with a dot, which readers pass over.
    """
    spark, (folder, _, name) = df.sparkSession, path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex
    made, old = f"{folder}/.{name}-{mark}", f"{folder}/.{name}-{mark}-old"
    df.write.parquet(made)
    had = folders.exists(spark, path)
    if had:
        folders.rename(spark, path, old)
    folders.rename(spark, made, path)
    if had:
        folders.delete(spark, old)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, in text files that Spark's JSON source reads back; null fields stay as nulls."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def percent(x: Column) -> Column:
    """A share as percent with one decimal, a dash where it is undefined."""
    return F.when(x.isNull() | F.isnan(x), F.lit(DASH)).otherwise(F.concat(F.format_number(100 * x, 1), F.lit("%")))


def markdown(df: DataFrame, columns: dict[str, Column], order: list[str]) -> DataFrame:
    """line, text: a Markdown table of df's rows in a total order, head first; bars inside a cell are escaped.

    Rows are numbered by one window, so this is for reports, not for tables of any size.
    """
    from pyspark.sql import Window as W

    spark = df.sparkSession
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit(DASH)), F.lit("|"), F.lit(r"\|"))
    text = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns.values()]), F.lit(" |"))
    rows = df.select((F.row_number().over(W.orderBy(*order)) + 1).alias("line"), text.alias("text"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "---|" * len(columns))]
    return spark.createDataFrame(head, "line int, text string").unionByName(rows)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report, in order, as one text file."""
    lines.coalesce(1).sortWithinPartitions("line").select("text").write.mode("overwrite").text(path)
