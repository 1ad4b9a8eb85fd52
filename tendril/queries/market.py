"""Market analytics on the star schema: orders as tenders, lineitem as items and awards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tendril.catalog import query, table
from tendril.operators import admin as A
from tendril.operators import market as M

AS_OF = datetime(2001, 1, 1)


def _d(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def tenders(spark, d):
    """Orders with the customer's nation and region names; the two small tables have bounded key sets."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    cust = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name")
    return table(spark, d, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


TENDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query(
    "by_region",
    f"SELECT n_name AS region, count(*) AS processes, {_d('o_totalprice')} AS total_value, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS open_processes, count(DISTINCT o_custkey) AS agencies FROM {TENDERS} GROUP BY 1"
)
def by_region(spark, d):
    return M.by_region(tenders(spark, d), "n_name", "o_totalprice", "o_orderdate", "o_custkey", AS_OF)


@query("summary_kpis", f"""SELECT *
   FROM (SELECT count(*) AS tenders, {_d('o_totalprice')} AS tender_value, count(*) FILTER (o_orderdate > TIMESTAMP '2001-01-01') AS open_tenders, count(o_totalprice) AS with_value, count(DISTINCT o_custkey) AS buyers, count(DISTINCT o_orderpriority) AS modalities,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date FROM orders),
 (SELECT count(*) AS items, {_d('l_extendedprice')} AS item_value, count(DISTINCT l_suppkey) AS active_suppliers, count(DISTINCT l_partkey) AS codes, count(*) FILTER (l_linestatus = 'F') AS contracts, {_d("CASE WHEN l_linestatus = 'F' THEN l_extendedprice END")} AS contract_value, count(*) FILTER (l_returnflag = 'R') AS cancelled FROM lineitem),
 (SELECT count(*) AS agencies, count(DISTINCT c_mktsegment) AS segments FROM customer), (SELECT count(*) AS suppliers
   FROM supplier), (SELECT count(*) AS catalogue, count(DISTINCT p_brand) AS brands FROM part),
 (SELECT count(*) AS changes, count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS changes_last_day, count(DISTINCT user_id) AS watchers
   FROM events), (SELECT count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents), (SELECT count(*) AS pages FROM pages)""")
def summary_kpis(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows, closed = F.count("*"), F.col("l_linestatus") == "F"
    return A.one_row([
        (table(spark, d, "orders"), {"tenders": rows, "tender_value": M.money("o_totalprice"), "open_tenders": F.count_if(F.col("o_orderdate") > F.lit(AS_OF)), "with_value": F.count("o_totalprice"), "buyers": F.countDistinct("o_custkey"),
                                     "modalities": F.countDistinct("o_orderpriority"), "first_date": day(F.min("o_orderdate")), "last_date": day(F.max("o_orderdate"))}),
        (table(spark, d, "lineitem"), {"items": rows, "item_value": M.money("l_extendedprice"), "active_suppliers": F.countDistinct("l_suppkey"), "codes": F.countDistinct("l_partkey"), "contracts": F.count_if(closed),
                                       "contract_value": M.money(F.when(closed, F.col("l_extendedprice"))), "cancelled": F.count_if(F.col("l_returnflag") == "R")}),
        (table(spark, d, "customer"), {"agencies": rows, "segments": F.countDistinct("c_mktsegment")}),
        (table(spark, d, "supplier"), {"suppliers": rows}),
        (table(spark, d, "part"), {"catalogue": rows, "brands": F.countDistinct("p_brand")}),
        (
            table(spark, d, "events"),
            {"changes": rows, "changes_last_day": F.count_if(F.col("ts") > F.lit("2024-01-29").cast("timestamp_ntz")), "watchers": F.countDistinct("user_id")}
        ),
        (table(spark, d, "documents"), {"documents": rows, "characters": F.sum("n_chars")}),
        (table(spark, d, "pages"), {"pages": rows}),
    ])


@query(
    "top_agencies",
    f"SELECT c_custkey, c_name, count(*) AS processes, {_d('o_totalprice')} AS total_value FROM {TENDERS} GROUP BY 1, 2 ORDER BY total_value DESC NULLS LAST, c_custkey, c_name LIMIT 25"
)
def top_agencies(spark, d):
    return M.top_by_value(tenders(spark, d), ["c_custkey", "c_name"], "o_totalprice")


@query("top_suppliers", f"""WITH a AS (SELECT l_suppkey, count(DISTINCT (l_orderkey, l_linenumber)) AS items, {_d('l_extendedprice')} AS awarded FROM lineitem GROUP BY 1),
 c AS (SELECT l_suppkey, count(*) AS contracts, {_d('l_extendedprice')} AS contracted FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
 SELECT l_suppkey, items, awarded, coalesce(contracts, 0) AS contracts, contracted FROM a LEFT JOIN c USING (l_suppkey) ORDER BY awarded DESC NULLS LAST, l_suppkey LIMIT 25""")
def top_suppliers(spark, d):
    li = table(spark, d, "lineitem")
    return M.top_suppliers(
        li, li.where(F.col("l_linestatus") == "F").withColumn("contract_value", F.col("l_extendedprice")), "l_suppkey",
        ["l_orderkey", "l_linenumber"], "l_extendedprice"
    )


@query("by_modality", f"SELECT o_orderpriority AS modality, count(*) AS processes, {_d('o_totalprice')} AS total_value FROM orders GROUP BY 1")
def by_modality(spark, d):
    return M.by_modality(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("monthly_market_cube", f"""SELECT strftime(o_orderdate, '%Y-%m') AS month, n_name AS region, o_orderpriority AS modality, count(*) AS processes, {_d('o_totalprice')} AS estimated,
 {_d("CASE WHEN o_orderstatus = 'F' THEN o_totalprice END")} AS awarded, count(*) FILTER (o_orderstatus = 'P') AS deserted, count(*) FILTER (o_orderstatus = 'O') AS failed FROM {TENDERS} GROUP BY 1, 2, 3""")
def monthly_market_cube(spark, d):
    s = F.col("o_orderstatus")
    return M.monthly_market_cube(
        tenders(spark, d), "o_orderdate", "n_name", "o_orderpriority", "o_totalprice", F.when(s == "F", F.col("o_totalprice")), "o_orderstatus",
        s == "P", s == "O"
    )


@query("monthly_supplier", f"""SELECT strftime(coalesce(l_shipdate, o_orderdate), '%Y-%m') AS month, l_suppkey AS supplier, s_nationkey AS region, max(s_name) AS name, count(*) AS awards, {_d('l_extendedprice')} AS total_value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
def monthly_supplier(spark, d):
    rows = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return M.monthly_supplier(rows, F.coalesce("l_shipdate", "o_orderdate"), "l_suppkey", "s_name", "s_nationkey", "l_extendedprice")


def _prices(spark, d):
    li = table(spark, d, "lineitem")
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    unit_price = F.col("l_extendedprice") / F.col("l_quantity")
    base = li.where(F.col("l_quantity") > 0).select(
        *key, F.col("l_returnflag").alias("unit"), unit_price.alias("price"), F.col("l_quantity").alias("quantity"),
        (F.col("l_linestatus") == "O").alias("sealed"), "l_linestatus", F.col("l_shipdate")
    )
    first = M.last_n(base, key, [F.col("l_shipdate"), F.col("price"), F.col("quantity"), F.col("unit")], 1)
    return M.price_memory(first, base.where(F.col("l_linestatus") == "F").select(*key, "price", "quantity"), key)


_PRICES = """WITH base AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS unit, l_extendedprice / l_quantity AS price, l_quantity AS quantity, l_linestatus = 'O' AS sealed, l_linestatus, l_shipdate FROM lineitem WHERE l_quantity > 0),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey ORDER BY l_shipdate, price, quantity, unit) AS k FROM base) WHERE k = 1),
 prices AS (SELECT l_orderkey, l_linenumber, l_partkey, 'ESTIMATED' AS phase, unit, price, quantity FROM firsts WHERE price > 0 AND NOT sealed
 UNION ALL SELECT b.l_orderkey, b.l_linenumber, b.l_partkey, 'AWARDED', f.unit, b.price, b.quantity FROM base b LEFT
   JOIN firsts f ON b.l_orderkey = f.l_orderkey AND b.l_linenumber = f.l_linenumber AND b.l_partkey = f.l_partkey WHERE b.l_linestatus = 'F' AND b.price > 0)"""


@query("price_memory", f"{_PRICES} SELECT phase, unit, count(*) AS n, CAST(sum(CAST(floor(price * 100) AS BIGINT)) AS BIGINT) AS cents FROM prices GROUP BY 1, 2")
def price_memory(spark, d):
    return _prices(spark, d).groupBy("phase", "unit").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("price") * 100)).alias("cents"))


@query("price_stats", f"""{_PRICES}
   SELECT phase, unit, count(*) AS n, round(CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) / count(*), 2) AS mean, min(price) AS low, max(price) AS high,
 round(quantile_cont(price, 0.1), 4) AS p10, round(quantile_cont(price, 0.25), 4) AS p25, round(quantile_cont(price, 0.5), 4) AS p50, round(quantile_cont(price, 0.75), 4) AS p75, round(quantile_cont(price, 0.9), 4) AS p90
 FROM prices JOIN part ON p_partkey = l_partkey WHERE p_name LIKE '%red%' GROUP BY 1, 2 HAVING count(*) >= 3""")
def price_stats(spark, d):
    from tendril.functions.text import text_matches

    part = table(spark, d, "part").where(text_matches(F.col("p_name"), F.array(F.lit("RÉD")))).select(F.col("p_partkey").alias("l_partkey"))
    return M.price_stats(_prices(spark, d).join(part, "l_partkey", "left_semi"), ["phase", "unit"])


@query("year_coverage", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY 1),
 g AS (SELECT strftime(x, '%Y-%m') AS month, CAST(year(x) AS INT) AS year
   FROM (SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), INTERVAL 1 MONTH)) AS x FROM orders)),
 i AS (SELECT CAST(year(l_shipdate) AS INT) AS year, count(*) AS items FROM lineitem GROUP BY 1)
 SELECT year, count(*) AS months_expected, count(n) AS months_present, round(count(n) * 100 / count(*), 1) AS presence_pct, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, strftime(min(lo), '%Y-%m-%d') AS first_date, strftime(max(hi), '%Y-%m-%d') AS last_date, coalesce(any_value(items), 0) AS items
 FROM g LEFT JOIN m USING (month) LEFT JOIN i USING (year) GROUP BY 1""")
def year_coverage(spark, d):
    return M.year_coverage(table(spark, d, "orders"), "o_orderdate", {"items": (table(spark, d, "lineitem"), "l_shipdate")})


@query("totals_by_year", """SELECT year, CAST(sum(tenders) AS BIGINT) AS tenders, CAST(sum(items) AS BIGINT) AS items, CAST(sum(events) AS BIGINT) AS events FROM (
 SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS tenders, 0 AS items, 0 AS events FROM orders GROUP BY 1 UNION ALL
   SELECT year(l_shipdate), 0, count(*), 0 FROM lineitem GROUP BY 1 UNION ALL SELECT year(ts), 0, 0, count(*) FROM events GROUP BY 1) GROUP BY 1""")
def totals_by_year(spark, d):
    return M.totals_by_year(
        {"tenders": (table(spark, d, "orders"), "o_orderdate"), "items": (table(spark, d, "lineitem"), "l_shipdate"), "events": (table(spark, d, "events"), "ts")}
    )


@query("source_year_counts", """SELECT o_orderpriority AS source, CAST(year(o_orderdate) AS INT) AS year, count(*) AS rows, 'tender' AS kind FROM orders GROUP BY 1, 2
 UNION ALL SELECT l_returnflag, CAST(year(l_shipdate) AS INT), count(*), 'item' FROM lineitem GROUP BY 1, 2""")
def source_year_counts(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return M.counts_by({"tender": (o, F.col("o_orderpriority"), F.year("o_orderdate")), "item": (li, F.col("l_returnflag"), F.year("l_shipdate"))})


@query("status_matrix", """WITH m AS (SELECT CAST(year(o_orderdate) AS INT) AS year, strftime(o_orderdate, '%m') AS month,
   CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 0 THEN 'CLOSED' ELSE 'PARTIAL' END AS state FROM orders GROUP BY 1, 2)
 SELECT year, string_agg(month || '=' || state, ','
   ORDER BY month) AS states, count(*) AS months, count(*) FILTER (state = 'CLOSED') AS closed, count(*) FILTER (state <> 'CLOSED') AS open, bool_and(state = 'CLOSED') AS year_closed FROM m GROUP BY 1""")
def status_matrix(spark, d):
    o = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.date_format("o_orderdate", "MM").alias("month")).agg(
        F.when(F.count_if(F.col("o_orderstatus") == "O") == 0, "CLOSED").otherwise("PARTIAL").alias("state")
    )
    m = M.import_matrix(o, "year", "month", "state", ["CLOSED"])
    return m.withColumn("states", F.array_join(F.transform(F.array_sort(F.map_entries("states")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(
    "registry_cards",
    "SELECT count(*) AS total, count(*) FILTER (p_size <= 10) AS p0, count(*) FILTER (p_size > 10 AND p_size <= 30) AS p1, count(*) FILTER (p_size > 30) AS p2, count(*) FILTER (p_brand = 'Brand#11') AS own_brand FROM part"
)
def registry_cards(spark, d):
    size = F.col("p_size")
    return M.cards(table(spark, d, "part"), "total", {"p0": size <= 10, "p1": (size > 10) & (size <= 30), "p2": size > 30, "own_brand": F.col("p_brand") == "Brand#11"})


@query("cross_source", "SELECT l_partkey, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def cross_source(spark, d):
    return M.cross_source_count(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("subscription_kpis", f"""WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'trial' ELSE 'cancelled' END AS status,
   CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice / 12 ELSE o_totalprice END AS monthly FROM orders)
 SELECT count(*) AS subscriptions, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'trial') AS trial, count(*) FILTER (status = 'cancelled') AS cancelled, {_d("CASE WHEN status = 'active' THEN round(monthly, 2) END")} AS mrr FROM s""")
def subscription_kpis(spark, d):
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").select(
        F.when(s == "F", "active").when(s == "O", "trial").otherwise("cancelled").alias("status"),
        F.when(F.col("o_orderpriority").like("1%"), "annual").otherwise("monthly").alias("cycle"), F.col("o_totalprice").alias("price")
    )
    return M.subscription_kpis(rows, "status", "cycle", "price")


@query("daily_report", """WITH k AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1),
 l AS (SELECT day, 'events' AS kpi, events AS value FROM k UNION ALL SELECT day, 'users', users FROM k UNION ALL SELECT day, 'errors', errors FROM k)
 SELECT day, kpi, value, lag(value) OVER w AS previous, value - lag(value) OVER w AS delta FROM l WINDOW w AS (PARTITION BY kpi ORDER BY day)""")
def daily_report(spark, d):
    k = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("events"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return M.daily_report(k, "day", ["events", "users", "errors"])


@query("month_vs_history", """WITH m AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2),
 b AS (SELECT o_orderpriority, CAST(coalesce(sum(n) FILTER (month = '2001-06'), 0) AS BIGINT) AS now, avg(n) FILTER (month <> '2001-06') AS base FROM m GROUP BY 1)
 SELECT o_orderpriority, now, round(base, 4) AS base, CASE WHEN base > 0 THEN round((now - base) / base * 100, 1) END AS delta_pct FROM b""")
def month_vs_history(spark, d):
    return M.month_vs_history(table(spark, d, "orders"), "o_orderpriority", "o_orderdate", "2001-06")


@query(
    "expiring_soon",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ends, CAST(date_diff('day', DATE '2000-06-01', CAST(o_orderdate AS DATE)) AS INT) AS days_left FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2000-11-28' ORDER BY days_left, o_orderkey LIMIT 50"
)
def expiring_soon(spark, d):
    return M.expiring(table(spark, d, "orders"), "o_orderdate", "o_orderkey", "2000-06-01", 180).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ends"), "days_left"
    )


@query(
    "last_n_per_source",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 8"
)
def last_n_per_source(spark, d):
    return M.last_n(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 8).select("user_id", "event_id", "event_type")


@query("source_health", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, event_type <> 'error' AS ok FROM events)
 SELECT user_id, count(*) AS runs, strftime(max(ts) FILTER (ok), '%Y-%m-%d %H:%M:%S') AS last_success, string_agg(CASE WHEN ok THEN '1'
   ELSE '0' END, '' ORDER BY k) FILTER (k <= 8) AS recent FROM r GROUP BY 1""")
def source_health(spark, d):
    return M.source_health(table(spark, d, "events"), "user_id", "ts", F.col("event_type") != "error", "event_id")


@query("latest_per_user", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def latest_per_user(spark, d):
    return M.latest_per(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).withColumnRenamed("event_type", "last_event")


@query("recent_events", "SELECT event_id, event_type, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, d):
    return M.newest(table(spark, d, "events"), "ts", "event_id", 50).select("event_id", "event_type", "user_id")


@query("status_counts", "SELECT string_agg(s || '=' || n, ',' ORDER BY s) AS by_status FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1)")
def status_counts(spark, d):
    return M.status_counts(table(spark, d, "orders"), "o_orderstatus").select(
        F.array_join(F.transform(F.array_sort(F.map_entries("by_status")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("by_status")
    )


@query(
    "run_summary",
    "SELECT event_type, count(*) AS runs, count(DISTINCT user_id) AS users, count(*) FILTER (value IS NULL) AS without_value, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1"
)
def run_summary(spark, d):
    return M.run_summary(table(spark, d, "events"), "event_type", "user_id", "value")


@query(
    "tender_list",
    "SELECT o_orderkey AS tender, c_name AS agency, n_name AS region, o_orderstatus AS status, o_orderpriority AS modality, o_totalprice AS value, strftime(o_orderdate, '%Y-%m-%d') AS published FROM "
    + TENDERS
)
def tender_list(spark, d):
    return tenders(spark, d).select(
        F.col("o_orderkey").alias("tender"), F.col("c_name").alias("agency"), F.col("n_name").alias("region"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("modality"), F.col("o_totalprice").alias("value"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("published")
    )
