"""Reports about the tables themselves, edits of rules with their history, and small relational helpers."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.text import text_matches
from tendril.operators.market import last_n


def where_given(df: DataFrame, conditions: dict[str, tuple[Column, object]]) -> DataFrame:
    """Rows that meet the conditions whose parameter is given: a plan without the others.

    ``conditions``: name to (condition, parameter); a parameter that is None is not given.
    """
    return reduce(DataFrame.where, [on for on, given in conditions.values() if given is not None], df)


def without_sentinels(df: DataFrame, sentinels: dict[str, str]) -> DataFrame:
    """Rows that stand for something: none of the columns holds its sentinel; nulls stay."""
    return reduce(DataFrame.where, [~F.col(c).eqNullSafe(F.lit(s)) for c, s in sentinels.items()], df)


def unnested(df: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """A row for each place of parallel arrays, with their elements; shorter arrays give nulls."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))


def mapped_join(left: DataFrame, right: DataFrame, name: str, mapping: dict[str, str], key: str, how: str = "inner") -> DataFrame:
    """``left`` joined by the key that ``mapping`` gives to its ``name``; names that are not mapped are keys themselves."""
    known = F.create_map(*map(F.lit, chain.from_iterable(mapping.items())))
    return left.withColumn(key, F.coalesce(F.try_element_at(known, F.col(name)), F.col(name))).join(right, key, how)


def datasets_by_source(connectors: DataFrame, files: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Files, complete files, lines and last completion by connector; connectors without files have zeros.

    ``connectors``: ``connector``; ``files``: ``source, status, lines, finished``; the
    connectors' names are mapped to the files' sources.
    """
    complete = F.col("status") == "COMPLETE"
    counts = files.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(complete).alias("complete"), F.sum("lines").alias("lines"),
        F.max(F.when(complete, F.col("finished"))).alias("last")
    )
    return mapped_join(connectors, counts, "connector", mapping, "source", "left").fillna(0, ["files", "complete", "lines"])


def canonical_totals(registry: DataFrame, duplicate: str) -> DataFrame:
    """Sources, those that are marked as duplicates, and the estimate of those that are left."""
    marked = F.count(duplicate)
    return registry.agg(F.count("*").alias("sources"), marked.alias("duplicates"), (F.count("*") - marked).alias("canonical"))


def running_first(df: DataFrame, status: str, running: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows, those that run before all others."""
    return df.orderBy((F.col(status) == running).desc_nulls_last(), *order).limit(n)


def one_row(parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Figures of several tables side by side: an aggregate a table, joined as single rows."""
    return reduce(DataFrame.crossJoin, [df.agg(*[c.alias(n) for n, c in figures.items()]) for df, figures in parts])


def memory_report(sections: dict[str, DataFrame], counts: dict[str, tuple[DataFrame, str]], method: str) -> DataFrame:
    """One JSON document about what is held: each section as a list of rows, each count as a map by status, and the method.

    Sections are report tables and must be limited already.
    """
    out = None
    for name, df in sections.items():
        row = F.struct(*df.columns)
        one = df.agg(F.array_sort(F.collect_list(F.to_json(row))).alias(name))
        out = one if out is None else out.crossJoin(one)  # single rows
    for name, (df, status) in counts.items():
        one = df.groupBy(status).agg(F.count("*").alias("n")).agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(status), F.lit("")).alias("k"), "n")))).alias(name)
        )
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct("*", F.lit(method).alias("method"))).alias("document"))


HISTORY = "monitor_id long, action string, config string, changed_by string, changed_at timestamp"


def edit_rules(rules: DataFrame, edits: DataFrame, history: DataFrame, changed_by: str, as_of) -> tuple[DataFrame, DataFrame]:
    """(rules after the edits, history with each rule before its edit and with the edit itself).

    ``edits`` has columns of ``rules``; null ones are not changed.  Nothing is
    archived for monitors that ``rules`` lack, and none is added.
    """
    fields = [c for c in edits.columns if c != "monitor_id"]
    new = edits.select("monitor_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    changed = [F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in rules.columns]
    after = rules.join(new, "monitor_id", "left").select(*changed)
    entry = lambda df, action: df.select(
        "monitor_id", F.lit(action).alias("action"), F.to_json(F.struct(*df.columns)).alias("config"), F.lit(changed_by).alias("changed_by"),
        F.lit(as_of).cast("timestamp").alias("changed_at")
    )
    before = rules.join(edits.select("monitor_id"), "monitor_id", "left_semi")
    known = edits.join(rules.select("monitor_id"), "monitor_id", "left_semi")
    return after, history.unionByName(entry(before, "before")).unionByName(entry(known, "edit"))


def clients(users: DataFrame, subscriptions: DataFrame, user: str, name: str, order: list[Column], q: str | None = None, n: int = 50) -> DataFrame:
    """Users with their latest subscription, the first ``n`` by user; only those whose name has the words of ``q``, if it is given."""
    found = where_given(users, {"q": (text_matches(F.col(name), F.array(F.lit(q or ""))), q)})
    return found.join(last_n(subscriptions, [user], order, 1), user, "left").orderBy(user).limit(n)
