"""Exact quantiles of groups of any size, by rank selection.

``percentile`` holds the distinct values of a group in one task.  That is fine for groups
up to ``limit`` rows; of larger ones there are few, and each wanted rank is looked for in a
range of values: approximate quantiles of the range, which combine before the shuffle, cut
it into parts, the parts' rows are counted exactly, and the part that holds the rank is the
next range.  A range whose values are equal, or that has ``limit`` rows at most, is done.
Each round divides the rows of a range by about ``CUTS``, so four rounds do for 10^12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.catalog import checkpointed

#: Rows of a group, at least, that are left to ``percentile``; parts of a range in a round.
LIMIT, CUTS = 1_000_000, 64
#: Groups above the limit are as many at most.
LARGE_GROUPS = 50_000


def _interpolated(low: Column, high: Column, at: Column) -> Column:
    """As ``percentile``: between the values at the ranks around ``at``."""
    floor, ceil = F.floor(at).cast("double"), F.ceil(at).cast("double")
    return F.when(floor == ceil, low).otherwise((ceil - at) * low + (at - floor) * high)


def exact_quantiles(df: DataFrame, by: list[str], value: str, points: list[float], limit: int = LIMIT) -> DataFrame:
    """``by`` and ``q``, the exact quantiles of ``value`` at ``points`` as ``percentile`` has them; nulls do not count.

    Groups without values are left out.  Null keys are a group.  The state of the
    search is written to the checkpoint folder in each round.
    """
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n"), F.max("_n")).first()
    own = [F.col(n).alias(c) for c, n in zip(by, names)]
    array = F.array(*[F.lit(float(p)) for p in points])
    limit = max(limit, (total[0] or 0) // LARGE_GROUPS)
    if (total[1] or 0) <= limit:
        return rows.groupBy(*names).agg(F.percentile("_v", array).alias("q")).select(*own, "q")
    large = checkpointed(sizes.where(F.col("_n") > limit))
    same = lambda other: [F.col(n).eqNullSafe(F.col(f"{other}{n}")) for n in names]
    named = lambda t, mark: t.withColumnsRenamed({n: f"{mark}{n}" for n in names})
    keys = named(large.select(*names), "b")
    small = rows.join(F.broadcast(keys), same("b"), "left_anti").groupBy(*names).agg(F.percentile("_v", array).alias("q"))
    inside = rows.join(F.broadcast(keys), same("b"), "left_semi")
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in points]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at])))
    nothing = F.lit(None).cast("double")
    wanted = checkpointed(
        large.select(*names, F.explode(ranks).alias("_rank"), nothing.alias("_lo"), nothing.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_in"))
    )
    done = []
    cuts = [k / CUTS for k in range(1, CUTS)]
    while True:
        ready = (F.col("_lo") == F.col("_hi")) | (F.col("_in") <= limit)
        done.append(wanted.where(F.coalesce(ready, F.lit(False))))
        wanted = wanted.where(~F.coalesce(ready, F.lit(False)))
        if wanted.isEmpty():
            break
        ranges = named(wanted.select(*names, "_lo", "_hi").distinct(), "b")
        held = inside.join(F.broadcast(ranges), [*same("b"), (F.col("_lo").isNull()) | F.col("_v").between(F.col("_lo"), F.col("_hi"))])
        pivots = held.groupBy(*names, "_lo", "_hi").agg(F.array_distinct(F.percentile_approx("_v", cuts, 20 * CUTS)).alias("_p"))
        parts = held.select(*names, "_lo", "_hi", "_v").join(
            F.broadcast(named(pivots, "p").withColumnsRenamed({"_lo": "_plo", "_hi": "_phi"})),
            [*same("p"), F.col("_lo").eqNullSafe(F.col("_plo")), F.col("_hi").eqNullSafe(F.col("_phi"))]
        )
        # a pivot's own value is a part by itself, so that a range always shrinks
        part = F.size(F.filter("_p", lambda p: p < F.col("_v"))) + F.size(F.filter("_p", lambda p: p <= F.col("_v")))
        counted = parts.groupBy(*names, "_lo", "_hi", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("_part")) - F.col("_c")
        counted = named(counted.withColumn("_before", before), "c").withColumnsRenamed({"_lo": "_clo", "_hi": "_chi"})
        there = [
            *same("c"), F.col("_lo").eqNullSafe(F.col("_clo")), F.col("_hi").eqNullSafe(F.col("_chi")), F.col("_rank") >= F.col("_below")
            + F.col("_before"), F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_c")
        ]
        found = wanted.join(counted, there)
        wanted = checkpointed(
            found.select(*names, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_in"))
        )
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    equal = settled.where(F.col("_lo") == F.col("_hi")).select(*names, "_rank", F.col("_lo").alias("_x"))
    few = settled.where(F.col("_lo").isNull() | (F.col("_lo") != F.col("_hi")))
    ends = named(few.select(*names, "_lo", "_hi").distinct(), "b")
    lists = inside.join(
        F.broadcast(ends), [*same("b"), F.col("_v").between(F.col("_lo"), F.col("_hi"))]
    ).groupBy(*names, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    lists = named(lists, "l").withColumnsRenamed({"_lo": "_llo", "_hi": "_lhi"})
    picked = few.join(lists, [*same("l"), F.col("_lo") == F.col("_llo"), F.col("_hi") == F.col("_lhi")]).select(
        *names, "_rank", F.get("_all", (F.col("_rank") - F.col("_below")).cast("int")).alias("_x")
    )
    held = equal.unionByName(picked).groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))
    held = named(large, "s").join(held, [F.col(f"s{n}").eqNullSafe(F.col(n)) for n in names])
    each = [_interpolated(F.col("_at")[F.floor(a)], F.col("_at")[F.ceil(a)], a) for a in at]
    return small.unionByName(held.select(*names, F.array(*each).alias("q"))).select(*own, "q")
