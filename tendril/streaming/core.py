"""Structured Streaming forms of the operators.

A stream reads files as they arrive.  Tables that change are kept in a shared
folder: each micro-batch leaves what it changes, and every few batches these parts
are merged into one.  A batch that runs again leaves the same part again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Everything that is there now, then stops; a later call goes on from the checkpoint."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


@dataclass(frozen=True)
class Merge:
    """What a micro-batch leaves, and how such parts make a table; merging parts that are merged already changes nothing."""

    fold: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


def add_counts(keys: list[str], count: str = "n") -> Merge:
    """Counters of rows by ``keys``."""
    return Merge(lambda batch: batch.groupBy(*keys).agg(F.count("*").alias(count)), lambda parts: parts.groupBy(*keys).agg(F.sum(count).alias(count)))


def keep_latest(keys: list[str], order: list[str]) -> Merge:
    """The latest row of each key: late and repeated rows change nothing, none is dropped by a watermark."""

    def best(rows: DataFrame) -> DataFrame:
        values = [c for c in rows.columns if c not in keys]
        found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_x"))
        return found.select(*keys, *[F.col("_x")[c].alias(c) for c in values])

    return Merge(best, best)


class MergedTable:
    """A table under ``folder`` that micro-batches add to.

    Batch n writes its own part.  Every ``every`` batches the parts since the last
    whole table and that table are merged into a new one, and the round before is
    emptied: a batch costs what it changes, and a row is written anew once a round.
    """

    def __init__(self, folder: str, how: Merge, every: int = 16):
        self.folder, self.how, self.every = folder, how, every

    def _whole_before(self, n: int) -> int:
        """The last batch up to ``n`` with a whole table, -1 if none has."""
        return (n + 1) // self.every * self.every - 1

    def after(self, spark: SparkSession, n: int) -> DataFrame | None:
        """The table after batch ``n``; None before the first."""
        if n < 0:
            return None
        whole = self._whole_before(n)
        paths = [f"{self.folder}/part-{k}" for k in range(whole + 1, n + 1)] + ([f"{self.folder}/whole-{whole}"] if whole >= 0 else [])
        return self.how.merge(spark.read.parquet(*paths))

    def put(self, batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        self.how.fold(batch).write.mode("overwrite").parquet(f"{self.folder}/part-{n}")
        if (n + 1) % self.every:
            return
        before = n - self.every
        paths = [f"{self.folder}/part-{k}" for k in range(before + 1, n + 1)] + ([f"{self.folder}/whole-{before}"] if before >= 0 else [])
        self.how.merge(spark.read.parquet(*paths)).write.mode("overwrite").parquet(f"{self.folder}/whole-{n}")
        for k in range(max(0, before - self.every + 1), before + 1):  # no batch that may run again needs these
            self._empty(spark, f"{self.folder}/part-{k}")
        if before - self.every >= 0:
            self._empty(spark, f"{self.folder}/whole-{before - self.every}")

    @staticmethod
    def _empty(spark: SparkSession, path: str) -> None:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def once_within(stream: DataFrame, keys: list[str], event_time: str, delay: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark's delay; rows later than that are dropped by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def level_alerts(folder: str, key: str, order: list[str], pct: str, limits: tuple[int, ...] = (70, 80, 90)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function, the twin of :func:`tendril.operators.quality.threshold_alerts`: an alert where a key's level is not the last one reported.

    ``order`` orders the rows of a key within a micro-batch; its first column is
    returned as well.  Each key's last level is kept between batches; rows below all
    limits are passed over.  Alerts of batch n are ``folder/alerts-n``.
    """
    last = MergedTable(f"{folder}/levels", keep_latest(["key"], ["n", *order]))
    level = F.lit(0)
    for limit in sorted(limits):
        level = F.when(F.col(pct) >= limit, F.lit(limit)).otherwise(level)

    def run(batch: DataFrame, n: int) -> None:
        rows = batch.select(F.col(key).alias("key"), *order, level.alias("level"), F.lit(n).alias("n")).where(F.col("level") > 0)
        before = last.after(batch.sparkSession, n - 1)
        both = rows if before is None else rows.unionByName(before.select(rows.columns))
        w = Window.partitionBy("key").orderBy("n", *order)
        found = both.withColumn("last_level", F.lag("level").over(w)).where((F.col("n") == n) & ~F.col("level").eqNullSafe(F.col("last_level")))
        found.select(order[0], "key", "level", "last_level").write.mode("overwrite").parquet(f"{folder}/alerts-{n}")
        last.put(rows, n)

    return run


def monthly(stream: DataFrame, date: str, keys: list[str], value: str) -> DataFrame:
    """Monthly counts and sums over a stream, for complete or update output."""
    return stream.groupBy(F.date_format(date, "yyyy-MM").alias("month"), *keys).agg(
        F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("total")
    )


def since(df: DataFrame, ts: str, as_of: Column, hours: int) -> DataFrame:
    """Rows of the last ``hours`` before ``as_of``."""
    return df.where((F.col(ts) > as_of - F.make_interval(hours=F.lit(hours))) & (F.col(ts) <= as_of))


def newest_partition(parts: DataFrame, day: str, as_of: str, back: int = 4) -> DataFrame:
    """The latest day that exists within ``back`` days of ``as_of``."""
    d = F.to_date(F.lit(as_of))
    return parts.where(F.col(day).between(F.date_sub(d, back), d)).agg(F.max(day).alias(day))
