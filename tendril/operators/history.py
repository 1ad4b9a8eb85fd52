"""Merging batches into current tables, change events, and version history.

Current tables are DataFrames; a merge returns the new table, and applying a batch
twice changes nothing the second time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.functions.parse import map_merge


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in ``order``, which should be total."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") == 1).drop("_k")


def _both(current: DataFrame, batch: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    values = [c for c in batch.columns if c not in keys]
    old = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in current.columns if c not in keys], F.lit(True).alias("_old"))
    new = batch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_new"))
    return old.join(new, keys, "full"), values


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], as_of, policy: dict[str, str] | None = None) -> DataFrame:
    """``batch`` merged over ``current``; both have one row a key, ``current`` also ``first_seen`` and ``last_seen``.

    ``policy`` by column: ``overwrite`` (default), ``keep`` (the old value where
    there is a row), ``coalesce_new`` (the new value unless null), ``touch_only``
    (as ``keep``), ``merge_map`` (new entries over old), ``append_text``.
    Columns that only ``current`` has stay.
    """
    joined, values = _both(current, batch, keys)
    policy = policy or {}

    def merged(c: str) -> Column:
        old, new = F.col(f"old_{c}"), F.col(f"new_{c}")
        if c not in values:
            return old.alias(c)
        how = policy.get(c, "overwrite")
        both = {
            "overwrite": lambda: new, "keep": lambda: old, "touch_only": lambda: old, "coalesce_new": lambda: F.coalesce(new, old), "merge_map": lambda: map_merge(old, new), "append_text": lambda: F.concat_ws(" ", old, new),
        }[how]()
        return F.when(F.col("_new").isNull(), old).when(F.col("_old").isNull(), new).otherwise(both).alias(c)

    now = F.lit(as_of)
    plain = [c for c in current.columns if c not in keys and c not in ("first_seen", "last_seen")]
    return joined.select(
        *keys, *map(merged, plain), F.coalesce("old_first_seen", now).alias("first_seen"),
        F.when(F.col("_new").isNotNull(), now).otherwise(F.col("old_last_seen")).alias("last_seen")
    )


def classify(current: DataFrame, batch: DataFrame, keys: list[str], compare: list[str]) -> DataFrame:
    """Counts of inserted, updated and unchanged keys of ``batch``."""
    joined, _ = _both(current, batch, keys)
    same = reduce(lambda a, b: a & b, [F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compare])
    there = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return joined.agg(F.count_if(F.col("_old").isNull()).alias("inserted"), F.count_if(there & ~same).alias("updated"), F.count_if(there & same).alias("unchanged"))


def tracked_events(current: DataFrame, batch: DataFrame, keys: list[str], tracked: dict[str, str]) -> DataFrame:
    """``NOVO_REGISTRO`` for new keys, and an event for each tracked field that changed, compared by type.

    ``tracked``: column to event type.  Values come out as text.
    """
    old = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in tracked], F.lit(True).alias("_old"))
    joined = batch.select(*keys, *tracked).join(old, keys, "left")
    none = F.lit(None).cast("string")
    event = lambda on, kind, field, a, b: F.when(on, F.struct(F.lit(kind).alias("type"), field.alias("field"), a.alias("old_value"), b.alias("new_value")))
    events = [event(F.col("_old").isNull(), "NOVO_REGISTRO", none, none, none)]
    events += [
        event(F.col("_old").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"old_{c}")), kind, F.lit(c), F.col(f"old_{c}").cast("string"), F.col(c).cast("string"))
        for c, kind in tracked.items()
    ]
    return joined.select(*keys, F.explode(F.filter(F.array(*events), lambda e: e.isNotNull())).alias("e")).select(*keys, "e.*")


def insert_if_absent(current: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``batch`` whose key it lacks; of several such rows one stays."""
    return current.unionByName(batch.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


def _same(a: Column, b: Column) -> Column:
    """Equal as text, or as numbers (1.0 and 1)."""
    return a.eqNullSafe(b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))


def _fields(state: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per key, field and batch row with its change flag; stored values stand at ``seq`` -1."""
    empty = F.create_map().cast("map<string,string>")
    stored = state.select("key", F.lit(-1).cast("long").alias("seq"), F.explode(F.coalesce("data", empty)).alias("field", "value"))
    new = batch.where(F.col("data").isNotNull()).select("key", F.col("seq").cast("long").alias("seq"), F.explode("data").alias("field", "value"))
    w = Window.partitionBy("key", "field").orderBy("seq")
    rows = stored.unionByName(new).withColumns({"old_value": F.lag("value").over(w), "_nth": F.row_number().over(w)})
    return rows.withColumn("changed", (F.col("seq") >= 0) & ((F.col("_nth") == 1) | ~_same(F.col("value"), F.col("old_value"))))


def state_diff(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents merged into their states: (events, new state, closed versions).

    ``state``: ``key, data map<string,string>, version``; ``batch``: ``key, seq,
    data``, where ``seq`` orders the rows of a key and keys may repeat.  A field
    changes when it differs from the last value known for it, or was not known;
    fields that a document lacks are not deleted; null documents are rejected, and
    a null stored document counts as empty.  The first row of an unknown key is
    ``NOVO_REGISTRO``.  Changed rows count versions.  Nothing is looped: values meet
    by key and field, and versions are running counts.
    """
    fields = _fields(state, batch)
    known = state.select("key", "version")
    rows = batch.where(F.col("data").isNotNull()).select("key", F.col("seq").cast("long").alias("seq"))
    touched = fields.where("changed").select("key", "seq").distinct().withColumn("any", F.lit(True))
    order = Window.partitionBy("key").orderBy("seq")
    steps = rows.join(touched, ["key", "seq"], "left").join(known, "key", "left").withColumn("is_new", F.col("version").isNull() & (F.row_number().over(order) == 1))
    steps = steps.withColumn("counts", F.col("is_new") | F.coalesce("any", F.lit(False)))
    steps = steps.withColumn("after", F.coalesce("version", F.lit(0)) + F.sum(F.col("counts").cast("int")).over(order))
    made = steps.where("counts").select("key", "seq", "is_new", "after")
    none = F.lit(None).cast("string")
    fresh = made.where("is_new").select("key", "seq", F.lit("NOVO_REGISTRO").alias("type"), none.alias("field"), none.alias("old_value"), none.alias("new_value"))
    diffs = fields.where("changed").join(made.where(~F.col("is_new")).select("key", "seq"), ["key", "seq"], "left_semi").select(
        "key", "seq", F.concat(F.upper("field"), F.lit("_ALTERADO")).alias("type"), "field", "old_value", F.col("value").alias("new_value")
    )
    events = fresh.unionByName(diffs)

    last = fields.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value")).groupBy("key").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("data")
    )
    version = made.groupBy("key").agg(F.max("after").alias("after"))
    keys = rows.select("key").union(known.select("key")).distinct()
    empty = F.create_map().cast("map<string,string>")
    after = keys.join(last, "key", "left").join(known, "key", "left").join(version, "key", "left").select(
        "key", F.coalesce("data", empty).alias("data"), F.coalesce("after", "version").cast("long").alias("version")
    )

    # the document before a changed row: each field's last value before it, carried along the field's rows
    closing = made.where(~F.col("is_new")).join(fields.select("key", "field").distinct(), "key").select(
        "key", "field", "seq", F.lit(None).cast("struct<value: string>").alias("said"), F.lit(0).alias("_late"), "after"
    )
    values = fields.select("key", "field", "seq", F.struct("value").alias("said"), F.lit(1).alias("_late"), F.lit(None).cast("long").alias("after"))
    upto = Window.partitionBy("key", "field").orderBy("seq", "_late").rowsBetween(Window.unboundedPreceding, -1)
    held = closing.unionByName(values).withColumn("held", F.last("said", ignorenulls=True).over(upto)).where(F.col("_late") == 0)
    entry = F.when(F.col("held").isNotNull(), F.struct("field", F.col("held.value").alias("value")))
    closed = held.groupBy("key", "seq", "after").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("data")).select(
        "key", F.col("seq").alias("closed_by"), "data", (F.col("after") - 1).cast("long").alias("version")
    )
    return events, after, closed


def version_intervals(state: DataFrame, after: DataFrame, closed: DataFrame, times: DataFrame) -> DataFrame:
    """Every version with the time it holds from and to: ``key, version, data, valid_from, valid_to``.

    ``state`` is what was there before, ``after`` and ``closed`` are those of
    :func:`state_diff`, ``times`` (``key, seq, at``) says when each row of the batch came.
    A closed version ends when the row that replaced it came; the current one has no
    end, and what was there before the batch has no known start.
    """
    begun = times.groupBy("key").agg(F.min_by("at", "seq").alias("_first"))
    known = state.select("key", F.lit(True).alias("_known"))
    closing = closed.join(times.select("key", F.col("seq").alias("closed_by"), F.col("at").alias("valid_to")), ["key", "closed_by"], "left")
    every = closing.select("key", "version", "data", "valid_to").unionByName(
        after.select("key", "version", "data", F.lit(None).cast(times.schema["at"].dataType).alias("valid_to"))
    )
    every = every.join(begun, "key", "left").join(known, "key", "left")
    start = F.lag("valid_to").over(Window.partitionBy("key").orderBy("version"))
    return every.select("key", "version", "data", F.coalesce(start, F.when(F.col("_known").isNull(), F.col("_first"))).alias("valid_from"), "valid_to")


def as_of_join(moments: DataFrame, versions: DataFrame, keys: list[str], at: str, valid_from: str) -> DataFrame:
    """Each row of ``moments`` with the version of its key that held at its time: null columns where none did yet.

    One sort by key and time, and the version is carried along: no range join.  Of
    versions that start at the same time the last by their columns counts; a version
    holds from its very moment on.  A null ``valid_from`` is before all times.
    Columns of ``versions`` other than the keys and ``valid_from`` are added.
    """
    added = [c for c in versions.columns if c not in (*keys, valid_from)]
    one = moments.select(
        *keys, F.col(at).alias("_at"), F.lit(1).alias("_late"), F.struct(*moments.columns).alias("_row"),
        F.lit(None).cast(versions.select(F.struct(*added).alias("x")).schema["x"].dataType).alias("_version")
    )
    other = versions.select(
        *keys, F.col(valid_from).alias("_at"), F.lit(0).alias("_late"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"),
        F.struct(*added).alias("_version")
    )
    along = Window.partitionBy(*keys).orderBy(
        F.col("_at").asc_nulls_first(), "_late", F.col("_version").asc_nulls_first()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = one.unionByName(other).withColumn("_held", F.last("_version", ignorenulls=True).over(along)).where(F.col("_late") == 1)
    return held.select("_row.*", *[F.col("_held")[c].alias(c) for c in added])


def rename_entity(tables: list[DataFrame], old: str, new: str, column: str = "entity") -> list[DataFrame]:
    return [t.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column))) for t in tables]


def recode(df: DataFrame, status: str, cases: list[tuple[Column, str]]) -> DataFrame:
    """``status`` by the first case that holds; else as it was."""
    out = F.col(status)
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return df.withColumn(status, out)


def patch(target: DataFrame, patches: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Columns of matching keys changed from ``patches`` by ``overwrite``, ``coalesce_new`` or ``append_text``; no key is added."""
    new = patches.select(*keys, *[F.col(c).alias(f"new_{c}") for c in policy], F.lit(True).alias("_new"))
    joined = target.join(new, keys, "left")
    how = {"overwrite": lambda c: F.col(f"new_{c}"), "coalesce_new": lambda c: F.coalesce(f"new_{c}", c), "append_text": lambda c: F.concat_ws(" ", c, f"new_{c}")}
    return joined.select(*[F.when(F.col("_new"), how[policy[c]](c)).otherwise(F.col(c)).alias(c) if c in policy else F.col(c) for c in target.columns])
