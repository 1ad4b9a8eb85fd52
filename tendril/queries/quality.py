"""Resolution, quality and plans: parts split by parity as two sources, months of orders as partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tendril.catalog import query, table
from tendril.operators import quality as Q
from tendril.operators import resolve as R
from tendril.plans.partitions import partition_plan


def _halves(spark, d):
    p = table(spark, d, "part")
    return p.where(F.col("p_partkey") % 2 == 0), p.where(F.col("p_partkey") % 2 == 1)


@query(
    "canonical_links",
    "SELECT 'pncp:' || o_orderkey AS canonical_key, 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS record_key FROM orders UNION ALL SELECT DISTINCT 'pncp:' || l_orderkey, 'lineitem', l_orderkey || '/' || l_linenumber FROM lineitem"
)
def canonical_links(spark, d):
    li = table(spark, d, "lineitem").withColumn("rec", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    return R.links_by_official_id({"orders": (table(spark, d, "orders"), "o_orderkey", "o_orderkey"), "lineitem": (li, "rec", "l_orderkey")})


_SUMS = "SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1"


@query(
    "value_conflicts",
    f"SELECT o.o_orderkey, 'o_totalprice' AS field, o_totalprice AS old_value, v AS new_value, 'lineitem' AS source FROM orders o JOIN ({_SUMS}) s ON s.o_orderkey = o.o_orderkey WHERE o_totalprice <> v AND o.o_orderkey % 9 <> 0"
)
def value_conflicts(spark, d):
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("o_totalprice")
    )
    known = table(spark, d, "orders").where(F.col("o_orderkey") % 9 == 0).select("o_orderkey", F.lit("o_totalprice").alias("field"), F.lit("lineitem").alias("source"))
    return R.value_conflicts(table(spark, d, "orders"), sums, "o_orderkey", "o_totalprice", "lineitem", known).drop("confidence")


def _resolved(spark, d):
    even, odd = _halves(spark, d)
    records = odd.select(
        F.concat(F.lit("r"), F.col("p_partkey")).alias("record_key"),
        F.when(F.col("p_partkey") % 101 == 0, F.lit(None)).otherwise(F.replace("p_name", F.lit(" "), F.lit(" \t "))).alias("agency"),
        F.concat(F.lit(" 0"), F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, "a").otherwise("/")).alias("number"),
        F.when(F.col("p_partkey") % 7 != 0, F.concat(F.col("p_type"), F.lit("-"), F.substring("p_brand", 7, 2))).alias("city_uf")
    )
    candidates = even.select(
        F.concat(F.lit("pncp:"), F.col("p_partkey")).alias("canonical_key"), F.upper("p_name").alias("agency"),
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string")).alias("purchase_no"),
        F.concat(F.lit("00."), F.col("p_size"), F.lit("/")).alias("process_no")
    )
    return R.resolve_by_name_number(records, candidates, "legacy")


_RES = """r AS (SELECT 'r' || p_partkey AS record_key, CASE WHEN p_partkey % 101 = 0 THEN ''
   ELSE lower(p_name) END AS name, CAST(p_size AS VARCHAR) AS number, CASE WHEN p_partkey % 7 <> 0 THEN upper(p_type) ELSE '?' END AS city,
   CASE WHEN p_partkey % 7 <> 0 THEN substr(p_brand, 7, 2) ELSE 'XX' END AS uf FROM part WHERE p_partkey % 2 = 1),
 c AS (SELECT 'pncp:' || p_partkey AS canonical_key, lower(p_name) AS name, CAST(p_size AS VARCHAR) AS number FROM part WHERE p_partkey % 2 = 0),
 h AS (SELECT record_key, count(DISTINCT canonical_key) AS n, min(canonical_key) AS one, string_agg(DISTINCT canonical_key, ','
   ORDER BY canonical_key) AS candidates FROM r JOIN c USING (name, number) WHERE name <> '' GROUP BY 1)"""


@query("resolve_name_number", f"""WITH {_RES} SELECT record_key,
   CASE WHEN name = '' THEN 'src:legacy:' || record_key WHEN n IS NULL THEN 'proc:' || uf || ':' || city || ':' || number ELSE one END AS canonical_key,
 CASE WHEN name = '' THEN 'source' WHEN n IS NULL THEN 'new' ELSE 'linked' END AS how FROM r LEFT JOIN h USING (record_key) WHERE name = '' OR n IS NULL OR n = 1""")
def resolve_name_number(spark, d):
    return _resolved(spark, d)[0]


@query("review_queue", f"WITH {_RES} SELECT record_key, candidates FROM h WHERE n > 1")
def review_queue(spark, d):
    new = _resolved(spark, d)[1].withColumn("resolved", F.lit(False))
    return R.queue_reviews(new.limit(0), new, ["record_key"], once=True).select("record_key", F.array_join("candidates", ",").alias("candidates"))


@query("sanction_keys", "SELECT DISTINCT 'ceis:' || s_nationkey || '-' || s_suppkey AS canonical_key, CAST(s_suppkey AS VARCHAR) AS record_key FROM supplier")
def sanction_keys(spark, d):
    s = table(spark, d, "supplier").withColumn("doc", F.concat_ws("-", "s_nationkey", "s_suppkey"))
    return R.canonical_by_document(s, "ceis", "doc", "s_suppkey")


@query("official_ids", r"""WITH k AS (SELECT o_orderkey,
   CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_custkey AS VARCHAR), 14, '0') || '-1-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/' || year(o_orderdate) ELSE 'L' || o_orderkey END AS key FROM orders)
 SELECT o_orderkey, CASE WHEN regexp_full_match(key, '\d{14}-\d-\d+/\d{4}') THEN key END AS possible_duplicate_of FROM k""")
def official_ids(spark, d):
    o = table(spark, d, "orders").withColumn(
        "key",
        F.when(
            F.col("o_orderkey") % 2 == 0,
            F.concat(F.lpad(F.col("o_custkey").cast("string"), 14, "0"), F.lit("-1-"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("/"), F.year("o_orderdate"))
        ).otherwise(F.concat(F.lit("L"), F.col("o_orderkey")))
    )
    return R.mark_possible_duplicates(o, "key").select("o_orderkey", "possible_duplicate_of")


@query(
    "placeholders_merged",
    """SELECT s.s_suppkey, coalesce(r.c_name, s.s_name) AS s_name, CASE WHEN r.c_name IS NOT NULL THEN 'DISCONTINUED' ELSE 'ACTIVE' END AS status FROM supplier s LEFT JOIN (SELECT c_custkey AS k, (SELECT s_name FROM supplier WHERE s_suppkey = c_custkey + 1) AS c_name FROM customer WHERE c_custkey % 10 = 0) r ON r.k = s.s_suppkey"""
)
def placeholders_merged(spark, d):
    reg = table(spark, d, "supplier").select("s_suppkey", "s_name").withColumn("status", F.lit("ACTIVE"))
    pairs = table(spark, d, "customer").where(F.col("c_custkey") % 10 == 0).select(F.col("c_custkey").alias("placeholder"), (F.col("c_custkey") + 1).alias("real"))
    return R.merge_placeholders(reg, pairs, "s_suppkey", "s_name", "status")


@query("dq_issues", """SELECT 'order' AS entity, CAST(o_orderkey AS VARCHAR) AS key, 'o_totalprice' AS field, 'value out of range' AS problem, CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) AS value FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders) WHERE o_totalprice > 450000
 UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'o_orderstatus', 'unknown status', o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def dq_issues(spark, d):
    o = table(spark, d, "orders").withColumn("o_totalprice", F.floor("o_totalprice"))
    return Q.issues(
        o, "order", "o_orderkey",
        {"value out of range": ("o_totalprice", F.col("o_totalprice") > 450000), "unknown status": ("o_orderstatus", ~F.col("o_orderstatus").isin("O", "F"))}
    )


_FILES = "SELECT strftime(o_orderdate, '%Y-%m') AS file, count(*) AS expected, count(*) FILTER (o_orderkey % 50 <> 0) AS processed, count(*) FILTER (o_orderkey % 100 = 0) AS errors FROM orders GROUP BY 1"


def _files(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("file")).agg(
        F.count("*").alias("expected"), F.count_if(F.col("o_orderkey") % 50 != 0).alias("processed"),
        F.count_if(F.col("o_orderkey") % 100 == 0).alias("errors")
    )


@query("coverage_mismatch", f"SELECT *, processed + errors < CAST(expected AS DOUBLE) * 0.98 AS mismatch FROM ({_FILES})")
def coverage_mismatch(spark, d):
    return Q.coverage_mismatch(_files(spark, d))


@query(
    "coverage_gaps",
    "SELECT year, count(*) AS open FROM (SELECT CAST(year(o_orderdate) AS INT) AS year, month(o_orderdate) AS m, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000) AS n FROM orders GROUP BY 1, 2) WHERE n > 0 GROUP BY 1"
)
def coverage_gaps(spark, d):
    m = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("m")).agg(
        F.count_if((F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 400000)).alias("n")
    )
    return Q.gaps(m.groupBy("year").agg(F.count_if(F.col("n") > 0).alias("open")))


@query("domain_check", "SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1")
def domain_check(spark, d):
    return Q.out_of_domain(table(spark, d, "events"), "event_type", ["view", "click"])


@query("repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated_keys(spark, d):
    return Q.repeated_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("threshold_alerts", """WITH l AS (SELECT event_id, user_id, ts, CASE WHEN value >= 90 THEN 90 WHEN value >= 80 THEN 80 WHEN value >= 70 THEN 70
   ELSE 0 END AS level FROM events),
 a AS (SELECT *, lag(level) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_level FROM l WHERE level > 0)
   SELECT event_id, user_id, level, last_level FROM a WHERE level IS DISTINCT FROM last_level""")
def threshold_alerts(spark, d):
    return Q.threshold_alerts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "level", "last_level")


@query("source_status", """WITH r AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type <> 'error') AS rows, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2)
 SELECT user_id, CASE WHEN arg_max(errors, day) > 0 AND arg_max(rows, day) = 0 THEN 'TEMPORARILY_UNAVAILABLE'
   ELSE 'ACTIVE' END AS status, max(day) FILTER (errors = 0) AS last_success FROM r GROUP BY 1""")
def source_status(spark, d):
    r = table(spark, d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("event_type") != "error").alias("rows"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return Q.source_status(r, "user_id", "rows", "errors", "day")


@query("partition_plan", """WITH s AS (SELECT DISTINCT o_orderpriority AS source, CAST(left(o_orderpriority, 1) AS INT) + p AS priority FROM orders, (SELECT unnest([0, 3]) AS p)),
 g AS (SELECT source, priority, CAST(year(m) AS INT) AS year, CAST(month(m) AS INT) AS month
   FROM s, (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS m)),
 f AS (SELECT o_orderpriority AS source, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month,
   CASE WHEN count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 7 = 0) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM orders GROUP BY 1, 2, 3),
 p AS (SELECT g.*, coalesce(status, 'QUEUED') AS status FROM g LEFT JOIN f USING (source, year, month) WHERE status IS DISTINCT FROM 'COMPLETE')
 SELECT source, priority, year, month, status, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN status = 'PARTIAL' THEN 0
   ELSE 1 END, priority, year DESC, month DESC) AS INT) AS place FROM p""")
def plan(spark, d):
    """Two priorities for each source: what is begun comes first in both."""
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderpriority").alias("source"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority")).distinct()
    s = s.withColumn("priority", F.explode(F.array("priority", F.col("priority") + 3)))
    done = o.groupBy(F.col("o_orderpriority").alias("source"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.when(F.count_if((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 7 == 0)) == 0, "COMPLETE").otherwise("PARTIAL").alias("status")
    )
    return partition_plan(s, "1995-01-01", "2001-12-01", done)
