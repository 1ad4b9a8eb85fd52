"""Cubes kept up to date under changes: what a batch changes is taken out as it was and put in as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.catalog import roomy, stored
from tendril.operators.market import month_of
from tendril.streaming.buckets import BucketTable


def _cells(rows: DataFrame, by: dict[str, Column], measures: dict[str, Column], sign: int) -> DataFrame:
    return rows.select(
        *[c.alias(n) for n, c in by.items()], F.lit(sign).cast("long").alias("n"),
        *[(F.coalesce(c, F.lit(0)) * sign).cast("decimal(38,4)").alias(n) for n, c in measures.items()]
    )


def added_up(cells: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Cells of equal keys as one; those that no row is left of are gone."""
    sums = cells.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(m).cast("decimal(38,4)").alias(m) for m in measures])
    return sums.where(F.col("n") != 0)


class LiveCube:
    """Counts and exact sums by ``by`` over the latest row of each key.

    ``rows`` is the table of current rows, ``cells`` the cube, bucketed by the first of
    ``by`` (a month, say): a batch reads the buckets of its keys and rewrites those of the
    months that it takes rows from or puts rows into.  The cube is written first, each
    under the batch's version, so a run that ends between the two is taken up again.
    What a batch adds to and takes from each cell is worked out once and written.
    """

    def __init__(self, rows: BucketTable, cells: BucketTable, by: dict[str, Column], measures: dict[str, Column], order: str):
        self.rows, self.cells, self.by, self.measures, self.order = rows, cells, by, measures, order

    @staticmethod
    def cells_schema(by: dict[str, str], measures: list[str]) -> str:
        return ", ".join([f"{n} {t}" for n, t in by.items()] + ["n long"] + [f"{m} decimal(38,4)" for m in measures])

    def latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the last by ``order``, equal ones by their values."""
        keys = self.rows.keys
        others = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(self.order, *others)).alias("_x"))
        return best.select(*[F.col(c) if c in keys else F.col("_x")[c].alias(c) for c in rows.columns])

    def apply(self, batch: DataFrame, version: int) -> None:
        """``batch`` has the columns of the table of rows; keys may repeat, and a row older than the one that is there changes nothing."""
        held = min(version - 1, self.rows.version())
        counts = self.rows.counts(batch)
        before = self.rows.read(sorted(counts), held)
        met = before.join(batch.select(*self.rows.keys).distinct(), self.rows.keys, "left_semi")
        after = self.latest(met.unionByName(batch.select(met.columns)))
        by, measures = list(self.by), list(self.measures)
        deltas = _cells(met, self.by, self.measures, -1).unionByName(_cells(after, self.by, self.measures, 1))
        deltas = deltas.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(m).cast("decimal(38,4)").alias(m) for m in measures])
        changed = deltas.where(" OR ".join(["n <> 0", *[f"{m} <> 0" for m in measures]]))
        with roomy(self.rows.spark, before.count() + sum(counts.values())):
            changed = stored(changed, "deltas")
        self.cells.merge(changed, lambda old, new: added_up(old.unionByName(new.select(old.columns)), by, measures), version)
        self.rows.merge(batch, lambda old, new: self.latest(old.unionByName(new.select(old.columns))), version)


def order_months(date: str, *others: str) -> dict[str, Column]:
    """The keys of a monthly cube: the month of ``date`` and other columns."""
    return {"month": month_of(date), **{c: F.col(c) for c in others}}
