"""Gapless numbering inside groups that may be as large as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from forumlens.sources.snapshots import materialize

CELL = "rank_cell"


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: places 0, 1, 2, ... without gaps inside every value of ``group``.

    The rows are written once together with the number of the task that made them, so a group is a chain of
    cells of at most one task's rows. Cells are numbered on their own and offset by the summed counts of the
    cells before them: no task ever holds a group, however large, and only counts meet by group. NULL is a
    group of its own. ``rows`` should be narrow and must not have columns ``rank_cell`` or ``name``.
    """
    kept = materialize(rows.withColumn(CELL, F.spark_partition_id()))
    counts = kept.groupBy(group, CELL).agg(F.count("*").alias("cell_rows"))
    before = Window.partitionBy(group).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, CELL, F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("cell_start"))
    inside = Window.partitionBy(group, CELL).orderBy(*order)
    placed = kept.withColumn(name, F.row_number().over(inside) - 1)
    return placed.join(starts, [group, CELL]).withColumn(name, F.col(name) + F.col("cell_start")).drop("cell_start", CELL)
