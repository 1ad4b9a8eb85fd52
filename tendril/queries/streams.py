"""Streams over the events and orders tables, each run over all that is there; SQL states the batch result."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.catalog import query, shared_folder, table
from tendril.queries.monitors import _ALERTS, AS_OF, _changed, _items, _records, fleet_sql, rules
from tendril.streaming import core as S
from tendril.streaming.fleet import Fleet


def _events(spark, d):
    schema = table(spark, d, "events").schema
    # a pattern, as a stream refuses the path of a single file
    return S.file_stream(spark, f"{d}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, folder: str, put: Callable[[DataFrame, int], None]) -> int:
    """Runs the stream over what is there; the number of the last batch, -1 if there was none."""
    seen = [-1]

    def counted(batch, n):
        put(batch, n)
        seen.append(n)

    S.run_available(stream.writeStream.foreachBatch(counted), f"{folder}-progress")
    return max(seen)


def _kept(spark, name: str, stream: DataFrame, how: S.Merge) -> DataFrame:
    kept = S.MergedTable(shared_folder(spark, name), how)
    n = _run(stream, kept.folder, kept.put)
    return how.merge(how.fold(spark.createDataFrame([], stream.schema))) if n < 0 else kept.after(spark, n)


@query("usage_counters", "SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2, 3")
def usage_counters(spark, d):
    e = _events(spark, d).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return _kept(spark, "usage", e, S.add_counts(["user_id", "event_type", "day"]))


@query("late_merge", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def late_merge(spark, d):
    e = _events(spark, d).select("user_id", "event_type", "event_id")
    return _kept(spark, "latest", e, S.keep_latest(["user_id", "event_type"], ["event_id"])).select("user_id", "event_type", "event_id")


@query("late_dedup", "SELECT event_id, user_id, event_type FROM events")
def late_dedup(spark, d):
    """Each event arrives twice, as by an overlapping re-read, and stays once."""
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    folder = shared_folder(spark, "dedup")
    S.run_available(
        S.once_within(twice, ["event_id"], "ts", "60 days").select("event_id", "user_id", "event_type").writeStream.format("parquet").outputMode("append").option("path", folder),
        f"{folder}-progress"
    )
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(folder)


@query("stream_monthly", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def stream_monthly(spark, d):
    folder = shared_folder(spark, "monthly")

    def put(batch, n):
        batch.write.mode("overwrite").parquet(folder)

    S.run_available(S.monthly(_events(spark, d), "ts", ["event_type"], "value").writeStream.outputMode("complete").foreachBatch(put), f"{folder}-progress")
    return spark.read.parquet(folder)


_LEVELS = """WITH l AS (SELECT event_id, user_id, CASE WHEN value >= 90 THEN 90 WHEN value >= 80 THEN 80 WHEN value >= 70 THEN 70 ELSE 0 END AS level FROM events),
 a AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY event_id) AS last_level FROM l WHERE level > 0)
   SELECT event_id, user_id AS key, level, last_level FROM a WHERE level IS DISTINCT FROM last_level"""


@query("stateful_alerts", _LEVELS)
def stateful_alerts(spark, d):
    """The events in two batches, so that levels are carried from one to the next."""
    folder = shared_folder(spark, "alerts")
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    half = e.agg(F.expr("max(event_id) div 2")).first()[0] or 0
    run = S.level_alerts(folder, "user_id", ["event_id"], "value")
    last = -1
    for part in (e.where(F.col("event_id") <= half), e.where(F.col("event_id") > half)):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        last = max(last, _run(S.file_stream(spark, f"{folder}/in", e.schema, 1), folder, run))
    return spark.read.schema("event_id long, key long, level int, last_level int").parquet(*[f"{folder}/alerts-{n}" for n in range(last + 1)])


@query("stream_resume", "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def stream_resume(spark, d):
    """A stream that stops and goes on from its checkpoint when more files are there: every event counts once."""
    folder = shared_folder(spark, "resume")
    e = table(spark, d, "events").select("event_id", "event_type")
    for k in (0, 1):
        e.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{folder}/in")
        rows = S.file_stream(spark, f"{folder}/in", e.schema, 2)
        S.run_available(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out"), f"{folder}-progress")
    return spark.read.schema(e.schema).parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


#: All files of a part, so that it is one micro-batch however many tasks have written it.
_ALL_FILES = 2**31 - 1


def _ticks(spark, name: str, parts: list[DataFrame], fleet: Callable[[str, object], Fleet]) -> DataFrame:
    """The alerts of all ticks, with the tick's number; each part of the records is a micro-batch."""
    folder = shared_folder(spark, name)
    schema = parts[0].schema
    ticking = fleet(folder, schema)
    last = -1
    for part in parts:
        part.select(schema.fieldNames()).write.mode("append").parquet(f"{folder}/in")
        last = max(last, _run(S.file_stream(spark, f"{folder}/in", schema, _ALL_FILES), folder, ticking.tick))
    own = [spark.read.parquet(f"{folder}/alerts-{n}").withColumn("tick", F.lit(n)) for n in range(last + 1)]
    return reduce(DataFrame.unionByName, own).withColumn("key", F.col("key").cast("long"))


@query("monitor_tick", f"WITH {_ALERTS} SELECT monitor_id, key, type, importance FROM alerts")
def monitor_tick(spark, d):
    """Two readings of the tenders as a stream: all monitors are evaluated on each, with what they remember."""
    first = _records(spark, d).where(F.col("key") % 3 != 0).withColumn("awarded", F.lit(None).cast("double"))
    listed = rules(spark).select("monitor_id", F.lit(True).alias("active"), F.lit(AS_OF).cast("timestamp").alias("next_run"), F.lit(0).alias("refresh_minutes"))
    fleet = lambda folder, schema: Fleet(spark, folder, schema, {"items": _items(spark, d)}, lambda n: rules(spark), lambda n: listed, lambda n: AS_OF, buckets=8)
    return _ticks(spark, "tick", [first, _changed(_records(spark, d))], fleet).select("monitor_id", "key", "type", "importance")


#: Three ticks an hour apart: which monitors are there from when, how often they run, which rule cannot be evaluated.
_TICKS = [datetime(2000, 6, 1, h) for h in (0, 1, 2)]
_MINUTES = {k: 30 for k in (1, 2, 3, 4, 6, 7, 9)} | {5: 90, 8: 90}
_ADDED = {6: 1, 9: 1}
_BROKEN = 3
#: What follows from these: the ticks at which a monitor is evaluated.
_EVALUATED = {1: (0, 1, 2), 2: (0, 1, 2), 4: (0, 1, 2), 5: (0, 2), 6: (1, 2), 7: (0, 1, 2), 8: (0, 2), 9: (1, 2)}


def _fleet_records(spark, d):
    """Records in three parts: some as they were first, then some as they are later, then the rest."""
    first = _records(spark, d).withColumn("awarded", F.lit(None).cast("double"))
    later = _changed(_records(spark, d))
    return [first.where(F.col("key") % 3 != 0), later.where(F.col("key") % 2 == 0), later.where(F.col("key") % 2 == 1)]


@query("monitor_fleet", fleet_sql(_EVALUATED, _TICKS))
def monitor_fleet(spark, d):
    """A fleet that changes: two monitors come later and start silently, two run every 90 minutes, one fails each time, the others go on."""
    broken = F.when(F.col("monitor_id") == _BROKEN, F.array(F.lit("ends in \\"))).otherwise(F.col("cities")).alias("cities")
    all_rules = rules(spark).where(F.col("monitor_id").isin(list(_MINUTES)))
    all_rules = all_rules.select(*[broken if c == "cities" else F.col(c) for c in all_rules.columns])

    def monitors(n):
        there = [k for k in _MINUTES if _ADDED.get(k, 0) <= n]
        return spark.createDataFrame([(k, True, _TICKS[0], _MINUTES[k]) for k in there], "monitor_id long, active boolean, next_run timestamp, refresh_minutes int")

    fleet = lambda folder, schema: Fleet(spark, folder, schema, {"items": _items(spark, d)}, lambda n: all_rules, monitors, lambda n: _TICKS[n], buckets=8)
    return _ticks(spark, "fleet", _fleet_records(spark, d), fleet).select("tick", "monitor_id", "key", "type", "importance")


@query("events_last_day", "SELECT event_type, count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-19' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def events_last_day(spark, d):
    return S.since(table(spark, d, "events"), "ts", F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz"), 24).groupBy("event_type").agg(F.count("*").alias("n"))


@query("latest_available", "SELECT max(strftime(ts, '%Y-%m-%d')) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-28' AND DATE '2024-02-01'")
def latest_available(spark, d):
    parts = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return S.newest_partition(parts, "day", "2024-02-01").select(F.date_format("day", "yyyy-MM-dd").alias("day"))
