"""Partitions that are still to be loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def partition_plan(sources: DataFrame, start: str, end: str, done: DataFrame | None = None) -> DataFrame:
    """Months from ``start`` to ``end`` for each of ``sources`` (``source, priority``), without completed ones, in order.

    ``done``: ``source, year, month, status``; ``COMPLETE`` ones are left out.
    ``PARTIAL`` ones come first, so that a month that was begun is ended before another is
    opened; then the priority counts, then the recent months.  A source may have several
    priorities, each for a data set of its own.
    """
    grid = sources.withColumn("first_day", F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 month)"))).select(
        "source", "priority", F.year("first_day").alias("year"), F.month("first_day").alias("month")
    )
    if done is not None:
        grid = grid.join(done.select("source", "year", "month", "status"), ["source", "year", "month"], "left").where(~F.col("status").eqNullSafe("COMPLETE"))
    else:
        grid = grid.withColumn("status", F.lit(None).cast("string"))
    state = F.coalesce("status", F.lit("QUEUED"))
    # one queue for each source: places are counted there, no task sorts the whole grid
    order = Window.partitionBy("source").orderBy(F.when(state == "PARTIAL", 0).otherwise(1), "priority", F.desc("year"), F.desc("month"))
    return grid.withColumn("status", state).withColumn("place", F.row_number().over(order))
