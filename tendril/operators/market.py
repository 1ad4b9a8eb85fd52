"""Market analytics: regions, rankings, monthly cubes, prices, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.operators.quantiles import exact_quantiles


def money(c: Column | str) -> Column:
    """An exact sum of amounts with two places, as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")


def by_region(df: DataFrame, region: str, value: str, closes: str, agency: str, as_of) -> DataFrame:
    """Processes, value, open processes and agencies by region; rows without a region are left out."""
    return df.where(F.col(region).isNotNull()).groupBy(F.col(region).alias("region")).agg(
        F.count("*").alias("processes"), money(value).alias("total_value"), F.count_if(F.col(closes) > F.lit(as_of)).alias("open_processes"), F.countDistinct(agency).alias("agencies")
    )


def top_by_value(df: DataFrame, keys: list[str], value: str, n: int = 25) -> DataFrame:
    """The ``n`` keys of the largest total, nulls last, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("processes"), money(value).alias("total_value")).orderBy(F.col("total_value").desc_nulls_last(), *keys).limit(n)


def top_suppliers(awards: DataFrame, contracts: DataFrame, supplier: str, item_key: list[str], value: str, n: int = 25) -> DataFrame:
    """Distinct awarded items and value by supplier, with the supplier's contracts, both summed before they meet."""
    a = awards.groupBy(supplier).agg(F.countDistinct(*item_key).alias("items"), money(value).alias("awarded"))
    c = contracts.groupBy(supplier).agg(F.count("*").alias("contracts"), money("contract_value").alias("contracted"))
    return a.join(c, supplier, "left").select(
        supplier, "items", "awarded", F.coalesce("contracts", F.lit(0)).alias("contracts"), "contracted"
    ).orderBy(F.col("awarded").desc_nulls_last(), supplier).limit(n)


def by_modality(df: DataFrame, modality: str, value: str) -> DataFrame:
    return df.groupBy(F.col(modality).alias("modality")).agg(F.count("*").alias("processes"), money(value).alias("total_value"))


def month_of(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly_market_cube(df: DataFrame, date: str, region: str, modality: str, estimated: str, awarded: Column, status: str, deserted: Column, failed: Column) -> DataFrame:
    return df.groupBy(month_of(date).alias("month"), F.col(region).alias("region"), F.col(modality).alias("modality")).agg(
        F.count("*").alias("processes"), money(estimated).alias("estimated"), money(awarded).alias("awarded"), F.count_if(deserted).alias("deserted"), F.count_if(failed).alias("failed")
    )


def monthly_supplier(awards: DataFrame, date: Column, supplier: str, name: str, region: str, value: str) -> DataFrame:
    return awards.groupBy(
        month_of(date).alias("month"), F.col(supplier).alias("supplier"), F.col(region).alias("region")
    ).agg(F.max(name).alias("name"), F.count("*").alias("awards"), money(value).alias("total_value"))


def price_memory(items: DataFrame, awards: DataFrame, item_key: list[str]) -> DataFrame:
    """Estimated prices (positive, not sealed) and awarded prices as one table; an award takes its item's unit.

    ``items`` has ``unit, price, quantity, sealed``; ``awards`` has ``price, quantity``.
    """
    wide = [*item_key, "phase", "unit", "price", "quantity"]
    estimated = items.where((F.col("price") > 0) & ~F.coalesce("sealed", F.lit(False))).withColumn("phase", F.lit("ESTIMATED"))
    awarded = awards.join(items.select(*item_key, "unit"), item_key, "left").where(F.col("price") > 0).withColumn("phase", F.lit("AWARDED"))
    return estimated.select(*wide).unionByName(awarded.select(*wide))


def price_stats(prices: DataFrame, by: list[str], price: str = "price", least: int = 3) -> DataFrame:
    """Count, mean, extremes and exact quantiles of groups with ``least`` rows, whatever their size."""
    points = [0.1, 0.25, 0.5, 0.75, 0.9]
    known = prices.where(F.col(price).isNotNull())
    mean = F.round(F.avg(F.col(price).cast("decimal(18,4)")).cast("double"), 2)
    stats = known.groupBy(*by).agg(F.count("*").alias("n"), mean.alias("mean"), F.min(price).alias("low"), F.max(price).alias("high")).where(F.col("n") >= least)
    q = exact_quantiles(known, by, price, points).withColumnsRenamed({c: f"_{c}" for c in by})
    both = stats.join(q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return both.select(*by, "n", "mean", "low", "high", *[F.round(F.col("q")[k], 4).alias(f"p{int(p * 100)}") for k, p in enumerate(points)])


def month_grid(df: DataFrame, date: str) -> DataFrame:
    """Every month from the first to the last of ``date``."""
    ends = df.agg(F.min(date).cast("date").alias("lo"), F.max(date).cast("date").alias("hi"))
    return ends.select(
        F.explode(F.expr("sequence(trunc(lo, 'MM'), trunc(hi, 'MM'), interval 1 month)")).alias("first_day")
    ).select(F.date_format("first_day", "yyyy-MM").alias("month"), F.year("first_day").alias("year"))


def year_coverage(df: DataFrame, date: str, children: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Months with rows out of the months of the grid, by year, with counts of child tables and first and last dates.

    Presence means at least one row in a month, not that the month is complete.
    """
    months = df.groupBy(month_of(date).alias("month")).agg(F.count("*").alias("rows"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    out = month_grid(df, date).join(months, "month", "left").groupBy("year").agg(
        F.count("*").alias("months_expected"), F.count("rows").alias("months_present"), F.round(F.count("rows") * 100 / F.count("*"), 1).alias("presence_pct"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.date_format(F.min("lo"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("hi"), "yyyy-MM-dd").alias("last_date"),
    )
    for name, (child, child_date) in (children or {}).items():
        counts = child.groupBy(F.year(child_date).alias("year")).agg(F.count("*").alias(name))
        out = out.join(counts, "year", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def counts_by(parts: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """(source, year, kind) counts over several tables given as kind: (df, source, year)."""
    rows = None
    for kind, (df, source, year) in parts.items():
        one = df.groupBy(source.alias("source"), year.alias("year")).agg(F.count("*").alias("rows")).withColumn("kind", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def totals_by_year(parts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Counts of several tables by year, one column each; years that a table lacks are 0."""
    rows = None
    for name, (df, date) in parts.items():
        one = df.groupBy(F.year(date).alias("year")).agg(F.count("*").alias(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.groupBy("year").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in parts])


def import_matrix(df: DataFrame, year: str, month: str, status: str, closed: list[str]) -> DataFrame:
    """By year: the months' states as a map, counts by kind of state, and whether all are closed."""
    is_closed = F.col(status).isin(*closed)
    return df.groupBy(year).agg(
        F.map_from_entries(
            F.array_sort(F.collect_set(F.struct(F.col(month), F.col(status))))
        ).alias("states"), F.count("*").alias("months"), F.count_if(is_closed).alias("closed"), F.count_if(~is_closed).alias("open"), F.every(is_closed).alias("year_closed")
    )


def cards(df: DataFrame, total: str, groups: dict[str, Column]) -> DataFrame:
    """One row of counts: all rows and those of each named condition."""
    return df.agg(F.count("*").alias(total), *[F.count_if(c).alias(n) for n, c in groups.items()])


def cross_source_count(links: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that more than one source has."""
    return links.groupBy(key).agg(F.countDistinct(source).alias("sources")).where(F.col("sources") > 1)


def last_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; limits are pushed below the shuffle by the window-limit rule."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def source_health(runs: DataFrame, source: str, ended: str, ok: Column, ident: str, n: int = 8) -> DataFrame:
    """Runs, last success and the last ``n`` runs' results by source, newest first; runs that end together go by ``ident``."""
    totals = runs.groupBy(source).agg(F.count("*").alias("runs"), F.date_format(F.max(F.when(ok, F.col(ended))), "yyyy-MM-dd HH:mm:ss").alias("last_success"))
    recent = last_n(runs.withColumn("_ok", ok), [source], [F.col(ended).desc(), F.col(ident).desc()], n).groupBy(source).agg(
        F.array_join(
            F.transform(F.reverse(F.array_sort(F.collect_list(F.struct(ended, ident, F.col("_ok").cast("int").alias("ok"))))), lambda x: x["ok"].cast("string")),
            ""
        ).alias("recent")
    )
    return totals.join(recent, source)


def daily_report(kpis: DataFrame, day: str, names: list[str]) -> DataFrame:
    """Each figure by day, with its change from the day before that has one."""
    long = kpis.unpivot([day], names, "kpi", "value")
    w = Window.partitionBy("kpi").orderBy(day)
    return long.withColumn("previous", F.lag("value").over(w)).withColumn("delta", F.col("value") - F.col("previous"))


def month_vs_history(df: DataFrame, key: str, date: str, current: str) -> DataFrame:
    """The rows of month ``current`` against the mean of the other months, by key; no change without others."""
    months = df.groupBy(F.col(key), month_of(date).alias("month")).agg(F.count("*").alias("n"))
    both = months.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("month") == current, F.col("n"))), F.lit(0)).alias("now"),
        F.avg(F.when(F.col("month") != current, F.col("n"))).alias("base")
    )
    return both.select(key, "now", F.round("base", 4).alias("base"), F.when(F.col("base") > 0, F.round((F.col("now") - F.col("base")) / F.col("base") * 100, 1)).alias("delta_pct"))


def expiring(df: DataFrame, ends: str, key: str, as_of: str, days: int, n: int = 50) -> DataFrame:
    """The ``n`` that end soonest within ``days`` of ``as_of``, with the days left; ties by key."""
    d = F.to_date(F.lit(as_of))
    left = F.datediff(F.col(ends), d)
    return df.where(F.to_date(ends).between(d, F.date_add(d, days))).withColumn("days_left", left).orderBy("days_left", key).limit(n)


def subscription_kpis(df: DataFrame, status: str, cycle: str, price: str) -> DataFrame:
    """Monthly recurring revenue of active rows (yearly prices by twelfths) and counts by status."""
    monthly = F.when(F.col(cycle) == "annual", F.col(price) / 12).otherwise(F.col(price))
    return df.agg(
        F.count("*").alias("subscriptions"), F.count_if(F.col(status) == "active").alias("active"),
        F.count_if(F.col(status) == "trial").alias("trial"), F.count_if(F.col(status) == "cancelled").alias("cancelled"),
        money(F.when(F.col(status) == "active", F.round(monthly, 2))).alias("mrr")
    )


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Counts by status as one map."""
    return df.groupBy(status).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("by_status"))


def progress_pct(done: Column, size: Column) -> Column:
    return F.when(size > 0, F.round(done * 100 / size, 1))



def future(kinds: dict[str, DataFrame], n: int = 30) -> DataFrame:
    """The ``n`` nearest of several kinds of purchases to come (``key, day``), ties by kind and key."""
    rows = [df.select(F.lit(kind).alias("kind"), "key", "day") for kind, df in kinds.items()]
    return reduce(DataFrame.unionByName, rows).orderBy("day", "kind", "key").limit(n)


def latest_per(df: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """``value`` of the last row of each key by ``order``; it combines before the shuffle."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def newest(df: DataFrame, when: str, ident: str, n: int) -> DataFrame:
    """The ``n`` newest rows; those of one time by the greater id."""
    return df.orderBy(F.col(when).desc(), F.col(ident).desc()).limit(n)


def run_summary(runs: DataFrame, kind: str, user: str, value: str) -> DataFrame:
    """Runs, users, runs without a value, and the exact total, by kind."""
    return runs.groupBy(kind).agg(
        F.count("*").alias("runs"), F.countDistinct(user).alias("users"), F.count_if(F.col(value).isNull()).alias("without_value"),
        F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total")
    )


def year_month_counts(df: DataFrame, date: str, years: DataFrame, name: str) -> DataFrame:
    """``year, month`` and the rows of each month of ``years``, 0 where there are none; the grid is years times twelve."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    counts = df.groupBy(F.year(date).alias("year"), F.month(date).alias("month")).agg(F.count("*").alias(name))
    return years.crossJoin(F.broadcast(months)).join(counts, ["year", "month"], "left").fillna(0, [name])


def pending(df: DataFrame, status: str, waiting: str, when: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows that still wait for their details."""
    return df.where(F.col(status) == waiting).orderBy(F.col(when).desc(), key).limit(n)


def frequent_without(df: DataFrame, key: str, excluded: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent keys with their counts, less those of ``excluded``, which has that column too."""
    top = df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
    return top.join(excluded.select(key), key, "left_anti")


def with_price_in(records: DataFrame, items: DataFrame, key: str, low, high) -> DataFrame:
    """Records that have some item (``unit_price``) in the range, by a semi-join."""
    return records.join(items.where(F.col("unit_price").between(low, high)).select(key), key, "left_semi")


def without_any(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that ``others`` has none for, by an anti-join."""
    return df.join(others.select(key), key, "left_anti")
