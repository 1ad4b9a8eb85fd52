"""Monitors over a stream of records: whose turn it is, what they see, and what they remember.

A micro-batch is a tick.  Its records go into a keyed table; the monitors whose turn has
come are evaluated together, each on the records that changed since it was evaluated last
(one whose rule looks at the time as well sees all).  A monitor that is new sees all records
and raises no news of them.  Matches and memory are keyed tables of which a tick reads and
writes the buckets that it meets.  Rules whose patterns are not well formed fail at once; if
the evaluation of several fails it is done again for halves of them, until those that fail
are alone.  A monitor that fails waits 30 minutes, the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from py4j.protocol import Py4JJavaError

from tendril.operators import monitors as M
from tendril.streaming.buckets import BucketTable

#: Monitors, as they are kept between ticks: ``seen`` is the last version of the records that a monitor was evaluated on.
FLEET = "monitor_id long, active boolean, next_run timestamp, refresh_minutes int, seen long"
DUE_AT_ONCE = 25


def isolated(ids: list[int], run: Callable[[list[int]], None]) -> dict[int, str | None]:
    """Runs ``run`` for all ids together; where that fails, for halves.  By id the error, or None."""
    try:
        run(ids)
        return dict.fromkeys(ids)
    except (PySparkException, Py4JJavaError) as error:
        if len(ids) == 1:
            return {ids[0]: str(error).splitlines()[0][:200] if str(error) else type(error).__name__}
        half = len(ids) // 2
        return isolated(ids[:half], run) | isolated(ids[half:], run)


class Fleet:
    """Monitors with their tables under ``folder``.

    ``records``: the schema of the stream, with a column ``key``; ``tables``: the other
    tables that :func:`tendril.operators.monitors.evaluate` reads; ``rules(n)`` and
    ``monitors(n)``: rules and monitors (``monitor_id, active, next_run, refresh_minutes``)
    as they are at tick n; ``clock(n)``: the time of tick n.  Monitors keep their place in
    the queue between ticks; those that were not there before run first when their time
    comes.  After tick n: ``alerts-n`` (with ``raised_at``) and ``fleet-n`` (with ``error``).
    """

    def __init__(
        self, spark: SparkSession, folder: str, records, tables: dict[str, DataFrame], rules: Callable[[int], DataFrame],
        monitors: Callable[[int], DataFrame], clock: Callable[[int], datetime], match_key: str = "string", buckets: int = 64
    ):
        self.spark, self.folder, self.tables, self.rules, self.monitors, self.clock = spark, folder, tables, rules, monitors, clock
        types = {f.name: f.dataType for f in records.fields}
        self.columns = records.fieldNames()
        base = spark.createDataFrame([], records).withColumn("_changed", F.lit(0).cast("long")).schema
        self.base = BucketTable(spark, f"{folder}/records", ["key"], base, buckets)
        kinds = {"value": "double", "awarded": "double", "closes": types["closes"].simpleString()}
        state = [
            f"monitor_id long, key {types['key'].simpleString()}", "first_seen timestamp, last_seen timestamp, last_checked timestamp",
            *[f"{c} {kinds.get(c, 'string')}" for c in M.SNAPSHOT]
        ]
        self.matches = BucketTable(spark, f"{folder}/matches", ["monitor_id", "key"], ", ".join(state), buckets)
        self.memory = BucketTable(spark, f"{folder}/memory", ["monitor_id", "entity", "key"], M.MEMORY, buckets)

    def fleet(self, n: int) -> DataFrame:
        """The monitors at tick n before it: those of the tick before, and new ones."""
        new = self.monitors(n).select("monitor_id", "active", "next_run", "refresh_minutes", F.lit(None).cast("long").alias("seen"))
        if n == 0:
            return new
        old = self.spark.read.schema(FLEET).parquet(f"{self.folder}/fleet-{n - 1}")
        told = self.monitors(n).select("monitor_id", F.col("active").alias("_active"), F.col("refresh_minutes").alias("_minutes"))
        old = old.join(told, "monitor_id", "left").withColumns({"active": F.coalesce("_active", "active"), "refresh_minutes": F.coalesce("_minutes", "refresh_minutes")})
        return old.select(*new.columns).unionByName(new.join(old.select("monitor_id"), "monitor_id", "left_anti"))

    def tick(self, batch: DataFrame, n: int) -> None:
        """A ``foreachBatch`` function; tick n again changes nothing that it has done."""
        spark, now, version = self.spark, self.clock(n), n + 1
        latest = batch.select(*self.columns, F.lit(version).cast("long").alias("_changed"))
        others = [c for c in latest.columns if c != "key"]
        self.base.merge(
            latest, lambda old,
            new: old.unionByName(new).groupBy("key").agg(
                F.max_by(F.struct(*others), F.struct("_changed", *others)).alias("_x")
            ).select("key", *[F.col("_x")[c].alias(c) for c in others]),
            version
        )
        fleet = self.fleet(n)
        turn = {r.monitor_id: r.seen for r in M.due(fleet, now, DUE_AT_ONCE).collect()}
        refused = self.rules(n).where(F.col("monitor_id").isin(list(turn)) & M.ill_formed(self.rules(n))).select("monitor_id").collect() if turn else []
        results: dict[int, str | None] = {r.monitor_id: "a pattern is not well formed" for r in refused}
        ids = sorted(set(turn) - set(results))
        results |= isolated(ids, lambda some: self._find(some, turn, now, n)) if ids else {}
        fine = [k for k, error in results.items() if error is None]
        self._settle(fine, turn, now, n)
        errors = spark.createDataFrame([(k, e is None, e) for k, e in results.items()], "monitor_id long, ok boolean, error string")
        seen = F.when(F.col("monitor_id").isin(fine), F.lit(version)).otherwise(F.col("seen")) if fine else F.col("seen")
        after = M.reschedule(fleet, errors, now).withColumn("seen", seen.cast("long"))
        after.join(errors.select("monitor_id", "error"), "monitor_id", "left").write.mode("overwrite").parquet(f"{self.folder}/fleet-{n}")
        for table in (self.base, self.matches, self.memory):
            table.clean()

    def _rules(self, ids: list[int], turn: dict[int, int | None], n: int) -> DataFrame:
        first = self.spark.createDataFrame([(k, turn[k] is None, turn[k]) for k in ids], "monitor_id long, first_run boolean, _seen long")
        return self.rules(n).join(F.broadcast(first), "monitor_id")  # as many as are due at once

    def _part(self, name: str, ids: list[int], n: int) -> str:
        return f"{self.folder}/found-{n}/{name}-{min(ids)}-{max(ids)}"

    def _find(self, ids: list[int], turn: dict[int, int | None], now: datetime, n: int) -> None:
        """Writes what these monitors match: their records, and what they find in the other tables."""
        rules = self._rules(ids, turn, n)
        records = self.base.read(version=n + 1)
        if all(turn[k] is not None for k in ids) and rules.where(F.col("opens_within_days").isNotNull()).isEmpty():
            records = records.where(F.col("_changed") > min(turn[k] for k in ids))
        hits = M.match_records(records, self.tables["items"], rules, now)
        asked = F.broadcast(rules.select("monitor_id", "_seen", F.col("opens_within_days").isNotNull().alias("_timed")))
        hits = hits.join(asked, "monitor_id").where(F.col("_seen").isNull() | F.col("_timed") | (F.col("_changed") > F.col("_seen")))
        path = self._part("matches", ids, n)
        M.snapshot(hits).write.mode("overwrite").parquet(path)
        own = self.spark.read.parquet(path).select("monitor_id", "key")
        known = own if self.matches.version() == 0 else own.unionByName(
            self.matches.read(version=min(n, self.matches.version())).where(F.col("monitor_id").isin(ids)).select("monitor_id", "key")
        ).distinct()
        for entity, found in M.once_found(self.tables, known, rules, now).items():
            found.withColumn("entity", F.lit(entity)).write.mode("overwrite").parquet(self._part(f"once-{entity}", ids, n))

    def _settle(self, ids: list[int], turn: dict[int, int | None], now: datetime, n: int) -> None:
        """Alerts of what was found, then the tables after it: alerts come from the tables before, so they are written first."""
        found = f"{self.folder}/found-{n}"
        names = self.matches._listed(found) if ids else []
        rules = self._rules(ids, turn, n)
        parts = lambda kind: [f"{found}/{x}" for x in names if x.startswith(kind)]
        alerts = self.spark.createDataFrame([], "monitor_id long, key string, type string, importance string, details string")
        hits = once = None
        if parts("matches-"):
            hits = self.spark.read.parquet(*parts("matches-")).where(F.col("monitor_id").isin(ids))
            state = self.matches.read(self.matches.touched(hits), min(n, self.matches.version()))
            alerts = alerts.unionByName(M.told(M.remember(state, hits, rules, now)[1]))
        if parts("once-"):
            once = self.spark.read.parquet(*parts("once-")).where(F.col("monitor_id").isin(ids))
            held = self.memory.read(self.memory.touched(once), min(n, self.memory.version()))
            kinds = [r.entity for r in once.select("entity").distinct().collect()]  # four at most
            new = [M.raise_once(held, once.where(F.col("entity") == k).drop("entity"), k, now, rules=rules)[1].select(*M.ALERT) for k in sorted(kinds)]
            alerts = reduce(DataFrame.unionByName, new, alerts)
        alerts.withColumn("raised_at", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{self.folder}/alerts-{n}")
        nothing = self.spark.createDataFrame([], self.matches.schema)
        self.matches.merge(nothing if hits is None else hits, (lambda old, _: old) if hits is None else (lambda old, new: M.remember(old, new, rules, now)[0]), n + 1)
        if once is None:
            self.memory.merge(self.spark.createDataFrame([], self.memory.schema), lambda old, _: old, n + 1)
            return
        keys = ["monitor_id", "entity", "key"]
        fresh = once.select(*keys, F.lit(now).cast("timestamp").alias("first_seen"))
        self.memory.merge(fresh, lambda old, new: old.unionByName(new).groupBy(*keys).agg(F.min("first_seen").alias("first_seen")), n + 1)
