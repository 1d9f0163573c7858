"""As-of joins: each row with the newest row of a timeline at or before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(rows: DataFrame, timeline: DataFrame, *, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``rows`` with the ``values`` of the newest ``timeline`` row of the same ``by`` and ``at`` not after.

    Both are laid into one order; equal places put the timeline first.  Rows before
    the timeline get nulls.  One shuffle by ``by`` serves the join.
    """
    side, value = free_name("side", rows, timeline), free_name("value", rows, timeline)
    left = rows.withColumn(side, F.lit(1)).withColumn(value, F.lit(None).cast(timeline.select(F.struct(*values).alias("v")).schema["v"].dataType))
    right = timeline.select(*by, at, F.lit(0).alias(side), F.struct(*values).alias(value))
    w = Window.partitionBy(*by).orderBy(at, side).rowsBetween(Window.unboundedPreceding, 0)
    laid = left.unionByName(right, allowMissingColumns=True).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return laid.filter(F.col(side) == 1).select(*rows.columns, *(F.col(value)[v].alias(v) for v in values))


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, or the first with underscores before it, that no column has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name = "_" + name
    return name
