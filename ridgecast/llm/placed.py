"""Places of rows in the order of their group, whatever share of all rows one group has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgecast.llm import tables
from ridgecast.session import cut_lineage

_TASK_ROWS = 1 << 33  # Spark's increasing ids hold the task above 33 bits


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``nth`` (from 0) in their group, in the given order (nulls first, ties as they stand), and the group's ``size``.

    One range exchange deals groups of any size over all tasks; each task counts what it holds of a group, and the
    counts of earlier tasks, one row for a task and group, are added. ``group`` is a column without nulls.
    """
    spark = rows.sparkSession
    keys = [group, *order, "_place"]
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(tables.partitions(spark), *keys)
    stored = cut_lineage(dealt.sortWithinPartitions(*keys).drop("_place").withColumn("_at", F.monotonically_increasing_id()))
    stored = stored.withColumn("_task", F.floor(F.col("_at") / _TASK_ROWS))
    held = stored.groupBy(group, "_task").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    tasks = Window.partitionBy(group).orderBy("_task")
    before = F.coalesce(F.sum("_n").over(tasks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(group))
    base = cut_lineage(held.select(group, "_task", (before - F.col("_first")).alias("_base"), whole.alias("size")))
    placed = stored.join(tables.maybe_broadcast(base, 64), [group, "_task"])
    return placed.select(*rows.columns, (F.col("_at") + F.col("_base")).alias("nth"), "size")
