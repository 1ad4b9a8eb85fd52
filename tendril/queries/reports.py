"""Dashboards, report documents, capability lists and the remaining small operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tendril.catalog import query, table
from tendril.functions.text import composite_key
from tendril.operators import admin as A
from tendril.operators import history as H
from tendril.operators import market as K
from tendril.operators import monitors as M
from tendril.operators import quality as Q
from tendril.queries.market import _d, tenders
from tendril.queries.monitors import _ALERTS_LATER, _FOLD, _RAISED, _RECORDS, AS_OF, LATER, RULES, _awards, _effective, _evaluated, _listed, _raised, _records, _words_sql, matches, rules
from tendril.sources import content as C
from tendril.sources import html as W


def _contracts(spark, d):
    """What monitors remember of contracts: items of the matched tenders that are still to be shipped."""
    i = table(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit(AS_OF)).groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("ends"), F.min("l_extendedprice").alias("value")
    )
    return matches(spark, d).select("monitor_id", "key").join(i, F.col("key") == F.col("l_orderkey")).select(
        "monitor_id", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), "ends", "value"
    )


_CONTRACTS = "contracts AS (SELECT monitor_id, l_orderkey || '/' || l_linenumber AS key, ends, value FROM (SELECT monitor_id, key AS k FROM matches) JOIN (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS ends, min(l_extendedprice) AS value FROM lineitem WHERE l_shipdate > TIMESTAMP '2000-06-01' GROUP BY 1, 2) ON k = l_orderkey)"


def _board(spark, d, section):
    alerts = _raised(_evaluated(spark, d)[1]) if section == "timeline" else spark.createDataFrame(
        [], "monitor_id long, key long, type string, importance string, raised_at timestamp"
    )
    return M.dashboard(matches(spark, d), _awards(spark, d), alerts, _contracts(spark, d), AS_OF)[section]


@query("dashboard_now", f"WITH {_RECORDS} SELECT monitor_id, count(*) AS open, {_d('value')} AS open_value FROM matches WHERE closes > TIMESTAMP '2000-06-01' GROUP BY 1")
def dashboard_now(spark, d):
    return _board(spark, d, "now")


@query("dashboard_market", f"WITH {_RECORDS} SELECT monitor_id, count(*) AS matches, {_d('value')} AS total_value FROM matches GROUP BY 1")
def dashboard_market(spark, d):
    return _board(spark, d, "market")


@query(
    "dashboard_open",
    f"WITH {_RECORDS} SELECT monitor_id, key, place FROM (SELECT monitor_id, key, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY closes, key) AS INT) AS place FROM matches WHERE closes > TIMESTAMP '2000-06-01') WHERE place <= 30"
)
def dashboard_open(spark, d):
    return _board(spark, d, "open").select("monitor_id", "key", "place")


@query("dashboard_agencies", f"""WITH {_RECORDS}, a AS (SELECT monitor_id, agency, count(*) AS processes, {_d('value')} AS total_value FROM matches GROUP BY 1, 2)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY total_value DESC NULLS LAST, agency) AS INT) AS place FROM a) WHERE place <= 10""")
def dashboard_agencies(spark, d):
    return _board(spark, d, "agencies")


@query("dashboard_map", f"WITH {_RECORDS} SELECT monitor_id, state, count(*) AS processes, {_d('value')} AS total_value FROM matches WHERE state IS NOT NULL GROUP BY 1, 2")
def dashboard_map(spark, d):
    return _board(spark, d, "map")


@query("dashboard_states", f"""WITH {_RECORDS}, a AS (SELECT monitor_id, state, {_d('value')} AS total_value FROM matches GROUP BY 1, 2)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY total_value DESC NULLS LAST, state) AS INT) AS place FROM a) WHERE place <= 10""")
def dashboard_states(spark, d):
    return _board(spark, d, "states")


@query("dashboard_series", f"WITH {_RECORDS} SELECT monitor_id, strftime(closes, '%Y-%m') AS month, count(*) AS processes, {_d('value')} AS total_value FROM matches GROUP BY 1, 2")
def dashboard_series(spark, d):
    return _board(spark, d, "series")


@query(
    "dashboard_future",
    f"WITH {_RECORDS}, {_CONTRACTS} SELECT monitor_id, key, place FROM (SELECT monitor_id, key, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY ends, key) AS INT) AS place FROM contracts) WHERE place <= 20"
)
def dashboard_future(spark, d):
    return _board(spark, d, "future").select("monitor_id", "key", "place")


@query("dashboard_future_value", f"WITH {_RECORDS}, {_CONTRACTS} SELECT monitor_id, count(*) AS contracts, {_d('value')} AS total_value FROM contracts GROUP BY 1")
def dashboard_future_value(spark, d):
    return _board(spark, d, "future_value")


@query(
    "dashboard_timeline",
    f"WITH {_ALERTS_LATER}, {_RAISED} SELECT monitor_id, key, type, importance, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY raised_at DESC, key, type) AS INT) AS place FROM raised) WHERE place <= 40"
)
def dashboard_timeline(spark, d):
    return _board(spark, d, "timeline").select("monitor_id", "key", "type", "importance", "place")


def _of_terms(kind: str, column: str) -> str:
    asked = lambda r: f" AND {column} IN {_listed(r[kind])}" if r[kind] else ""
    flag = "registers" if kind == "states" else "plans"
    return " UNION ALL ".join(
        f"SELECT CAST({r['monitor_id']} AS BIGINT) AS monitor_id, key FROM reg WHERE {_words_sql(_effective(r), 'folded')} AND NOT {_words_sql(r['exclude'], 'folded')}{asked(r)}"
        for r in RULES if r[flag] is not False
    )


@query(
    "register_alerts",
    f"WITH reg AS (SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'NATION_7' ELSE p_brand END AS state, {_FOLD.format('p_name')} AS folded FROM part WHERE p_size % 5 <> 0) SELECT monitor_id, key, 'NEW_ATA' AS type, 'media' AS importance FROM ({_of_terms('states', 'state')}) WHERE key % 4 <> 1"
)
def register_alerts(spark, d):
    """Registers that are not remembered from a silent first run."""
    reg = table(spark, d, "part").select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("text"),
        F.when(F.col("p_size") % 2 == 0, "NATION_7").otherwise(F.col("p_brand")).alias("state"), (F.col("p_size") % 5 == 0).alias("cancelled")
    )
    memory, silent = M.raise_once(spark.createDataFrame([], M.MEMORY), M.register_alerts(reg.where(F.col("key") % 4 == 1), rules(spark)), "register", AS_OF, first_run=True)
    return M.raise_once(memory, silent.unionByName(M.register_alerts(reg, rules(spark))), "register", AS_OF)[1].drop("details")


@query(
    "plan_alerts",
    f"WITH reg AS (SELECT p_partkey AS key, p_brand AS agency, {_FOLD.format('p_name')} AS folded FROM part) SELECT monitor_id, key, 'NEW_PCA' AS type, 'media' AS importance FROM ({_of_terms('agencies_in', 'agency')})"
)
def plan_alerts(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("text"), F.col("p_brand").alias("agency"))
    return M.raise_once(spark.createDataFrame([], M.MEMORY), M.plan_alerts(p, rules(spark)), "plan", AS_OF)[1].drop("details")


def _whole(r):
    out = []
    for t in _effective(r):
        ws = [w for w in re.split(r"[^\w]+", t.lower().replace("é", "e")) if len(w) > 1]
        if ws:
            out.append("(" + " AND ".join(f"list_contains(ws, '{w}')" for w in ws) + ")")
    return "(" + (" OR ".join(out) or "false") + ")"


@query(
    "match_by_token",
    f"""WITH w AS (SELECT p_partkey AS key, string_split({_FOLD.format('p_name')}, ' ') AS ws FROM part) {' UNION ALL '.join(f"SELECT CAST({r['monitor_id']} AS BIGINT) AS monitor_id, key FROM w WHERE {_whole(r)}" for r in RULES)}"""
)
def match_by_token(spark, d):
    return M.match_by_token(table(spark, d, "part"), "p_partkey", "p_name", rules(spark))


@query(
    "capability_matrix",
    "SELECT 'orders' AS connector, 'tenders' AS capability, count(*) AS rows FROM orders UNION ALL SELECT 'orders', 'items', count(*) FROM lineitem UNION ALL SELECT 'registry', 'suppliers', count(*) FROM supplier UNION ALL SELECT 'registry', 'catalogue', count(*) FROM part UNION ALL SELECT 'stream', 'events', count(*) FROM events UNION ALL SELECT 'web', 'pages', count(*) FROM pages"
)
def capability_matrix(spark, d):
    parts = [
        ("orders", "tenders", "orders"), ("orders", "items", "lineitem"), ("registry", "suppliers", "supplier"), ("registry", "catalogue", "part"),
        ("stream", "events", "events"), ("web", "pages", "pages")
    ]
    out = None
    for connector, capability, name in parts:
        one = table(spark, d, name).agg(F.count("*").alias("rows")).select(F.lit(connector).alias("connector"), F.lit(capability).alias("capability"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


#: Connectors whose files are listed under other names.
_CONNECTORS = {"newspapers": "news", "code": "forge"}


@query("datasets_by_source", """WITH f AS (SELECT source, count(*) AS files, count(*) FILTER (n_chars > 2000) AS complete, CAST(sum(n_chars) AS BIGINT) AS lines, max(doc_id) FILTER (n_chars > 2000) AS last FROM documents GROUP BY 1),
 c AS (SELECT DISTINCT source AS connector FROM documents UNION SELECT 'newspapers' UNION SELECT 'idle')
   SELECT connector, coalesce(files, 0) AS files, coalesce(complete, 0) AS complete, coalesce(lines, 0) AS lines, last FROM c LEFT
   JOIN f ON source = CASE connector WHEN 'newspapers' THEN 'news' WHEN 'code' THEN 'forge' ELSE connector END""")
def datasets_by_source(spark, d):
    docs = table(spark, d, "documents")
    names = docs.select(F.col("source").alias("connector")).distinct().unionByName(spark.createDataFrame([("newspapers",), ("idle",)], "connector string")).distinct()
    files = docs.select("source", F.when(F.col("n_chars") > 2000, "COMPLETE").alias("status"), F.col("n_chars").alias("lines"), F.col("doc_id").alias("finished"))
    return A.datasets_by_source(names, files, _CONNECTORS).drop("source")


@query(
    "canonical_totals",
    "SELECT count(*) AS sources, count(dup) AS duplicates, count(*) - count(dup) AS canonical FROM (SELECT url, CASE WHEN row_number() OVER (PARTITION BY html ORDER BY page_id) > 1 THEN 1 END AS dup FROM pages)"
)
def canonical_totals(spark, d):
    first = table(spark, d, "pages").groupBy("html").agg(F.min("page_id").alias("kept"))
    marked = table(spark, d, "pages").join(first, "html").withColumn("duplicate", F.when(F.col("page_id") != F.col("kept"), F.col("kept")))
    return A.canonical_totals(marked, "duplicate")


@query("running_first", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey LIMIT 120")
def running_first(spark, d):
    return A.running_first(table(spark, d, "orders"), "o_orderstatus", "P", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 120).select("o_orderkey", "o_orderstatus")


@query("memory_report", """SELECT (SELECT count(*) FROM (SELECT DISTINCT year(o_orderdate) FROM orders)) AS years, (SELECT count(*)
   FROM (SELECT DISTINCT o_orderpriority, year(o_orderdate) FROM orders)) AS by_source, least(120, (SELECT count(*) FROM orders)) AS queue,
 (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, 'presence' AS method""")
def memory_report(spark, d):
    """The report as one document, and what a reader finds in it."""
    o = table(spark, d, "orders")
    sections = {
        "coverage": K.year_coverage(o, "o_orderdate"),
        "by_source": K.counts_by({"tenders": (o, F.col("o_orderpriority"), F.year("o_orderdate"))}),
        "queue": A.running_first(o, "o_orderstatus", "P", [F.col("o_orderdate").desc(), F.col("o_orderkey")], 120),
    }
    doc = A.memory_report(sections, {"status": (o, "o_orderstatus")}, "presence")
    size = lambda name: F.json_array_length(F.get_json_object("document", f"$.{name}")).cast("long")
    years = F.size(F.array_distinct(F.transform(F.from_json(F.get_json_object("document", "$.coverage"), "array<string>"), lambda x: F.get_json_object(x, "$.year")))).cast("long")
    return doc.select(
        years.alias("years"), size("by_source").alias("by_source"), size("queue").alias("queue"),
        F.get_json_object("document", "$.status.O").cast("long").alias("open"), F.get_json_object("document", "$.method").alias("method")
    )


@query("config_history", """WITH r AS (SELECT p_partkey AS monitor_id, p_name AS include, p_size AS value_min FROM part), e AS (SELECT monitor_id,
   CASE WHEN monitor_id % 2 = 0 THEN 'edited' END AS include, value_min + 1 AS value_min FROM r WHERE monitor_id % 10 < 3)
 SELECT 'rule' AS what, r.monitor_id, coalesce(e.include, r.include) AS include, coalesce(e.value_min, r.value_min) AS value_min FROM r LEFT
   JOIN e USING (monitor_id) UNION ALL SELECT 'before', monitor_id, r.include, r.value_min FROM r WHERE monitor_id % 10 < 3 UNION ALL
   SELECT 'edit', monitor_id, include, value_min FROM e""")
def config_history(spark, d):
    r = table(spark, d, "part").select(F.col("p_partkey").alias("monitor_id"), F.col("p_name").alias("include"), F.col("p_size").alias("value_min"))
    k = F.col("monitor_id")
    edits = r.where(k % 10 < 3).select("monitor_id", F.when(k % 2 == 0, F.lit("edited")).alias("include"), (F.col("value_min") + 1).alias("value_min"))
    edits = edits.unionByName(spark.createDataFrame([(-1, "nobody", 1)], "monitor_id long, include string, value_min int"))
    after, history = A.edit_rules(r, edits, spark.createDataFrame([], A.HISTORY), "u", AS_OF)
    field = lambda name: F.get_json_object("config", f"$.{name}")
    told = history.select(F.col("action").alias("what"), "monitor_id", field("include").alias("include"), field("value_min").cast("int").alias("value_min"))
    return after.select(F.lit("rule").alias("what"), "monitor_id", "include", "value_min").unionByName(told)


@query("clients", """WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
 SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN s ON o_custkey = c_custkey AND k = 1
   WHERE lower(c_name) LIKE '%customer#%' AND lower(c_name) LIKE '%7%' AND lower(c_name) LIKE '%17%' ORDER BY c_custkey LIMIT 50""")
def clients(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    found = A.clients(c, s, "c_custkey", "c_name", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], "customer# 17")
    return found.select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query("optional_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 200000 AND o_orderpriority IS DISTINCT FROM '5-LOW'")
def optional_filters(spark, d):
    """Conditions of given parameters only, and no rows of a sentinel."""
    status, least, most = "O", 200_000, None
    o = A.where_given(
        table(spark, d, "orders"),
        {"status": (F.col("o_orderstatus") == status, status), "least": (F.col("o_totalprice") >= least, least), "most": (F.col("o_totalprice") <= F.lit(most), most)}
    )
    return A.without_sentinels(o, {"o_orderpriority": "5-LOW"}).select("o_orderkey")


@query("unnested", "SELECT user_id, event_id AS event, user_id + event_id AS both, CASE WHEN event_id % 2 = 0 THEN 1 END AS even FROM events")
def unnested(spark, d):
    """Parallel arrays of each user's events, of which the last may be shorter, as rows again."""
    e = table(spark, d, "events").groupBy("user_id", (F.col("event_id") % 2).alias("odd")).agg(F.array_sort(F.collect_list("event_id")).alias("event"))
    e = e.select(
        "user_id", "event", F.transform("event", lambda x: x + F.col("user_id")).alias("both"),
        F.when(F.col("odd") == 0, F.transform("event", lambda _: F.lit(1))).otherwise(F.array().cast("array<int>")).alias("even")
    )
    return A.unnested(e, ["event", "both", "even"], ["user_id"])


@query("future_purchases", """SELECT * FROM (SELECT 'tender' AS kind, o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
   WHERE o_orderdate > TIMESTAMP '2001-07-25' UNION ALL SELECT 'contract', l_orderkey * 10 + l_linenumber, strftime(l_shipdate, '%Y-%m-%d')
   FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-11-20'
 UNION ALL SELECT 'plan', p_partkey, strftime(DATE '2001-07-25' + CAST(p_size AS INT), '%Y-%m-%d') FROM part WHERE p_size > 20) ORDER BY day, kind, key LIMIT 30""")
def future_purchases(spark, d):
    day = lambda c: F.to_date(c)
    o = table(spark, d, "orders").where(F.col("o_orderdate") > F.lit("2001-07-25").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("day"))
    i = table(spark, d, "lineitem").where(F.col("l_shipdate") > F.lit("2001-11-20").cast("timestamp_ntz")).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), day("l_shipdate").alias("day")
    )
    p = table(spark, d, "part").where(F.col("p_size") > 20).select(F.col("p_partkey").alias("key"), F.date_add(F.to_date(F.lit("2001-07-25")), F.col("p_size")).alias("day"))
    return K.future({"tender": o, "contract": i, "plan": p}, 30).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("pending_details", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def pending_details(spark, d):
    return K.pending(table(spark, d, "orders"), "o_orderstatus", "P", "o_orderdate", "o_orderkey", 100).select("o_orderkey")


@query(
    "frequent_keys_left",
    "SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 40) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
)
def frequent_keys_left(spark, d):
    known = table(spark, d, "customer").where(F.col("c_acctbal") < 0).select(F.col("c_custkey").alias("o_custkey"))
    return K.frequent_without(table(spark, d, "orders"), "o_custkey", known, 40)


@query(
    "cross_join_grid",
    "SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month, (SELECT count(*) FROM orders WHERE year(o_orderdate) = y AND month(o_orderdate) = m) AS tenders FROM range(1995, 2002) a(y), range(1, 13) b(m)"
)
def cross_join_grid(spark, d):
    return K.year_month_counts(table(spark, d, "orders"), "o_orderdate", spark.range(1995, 2002).select(F.col("id").cast("int").alias("year")), "tenders")


@query("heal_documents", "SELECT event_id, event_id % 3 = 0 AS healed FROM events")
def heal_documents(spark, d):
    e = table(spark, d, "events").withColumn("doc", F.when(F.col("event_id") % 3 == 0, F.lit('"text"')).otherwise(F.col("props")))
    return Q.heal_documents(e, "doc", ["event_id", "value"]).select("event_id", F.get_json_object("doc", "$.event_id").isNotNull().alias("healed"))


@query("rename_entity", "SELECT CASE WHEN event_type = 'view' THEN 'visit' ELSE event_type END AS entity, count(*) AS n FROM events GROUP BY 1")
def rename_entity(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("entity"))
    return H.rename_entity([e], "view", "visit")[0].groupBy("entity").agg(F.count("*").alias("n"))


@query(
    "report_maps",
    "SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS report FROM (SELECT user_id, event_type, arg_max(event_id, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1"
)
def report_maps(spark, d):
    """Report maps of two readings, the later over the earlier."""
    e = table(spark, d, "events")
    m = lambda df: df.groupBy("user_id", "event_type").agg(F.max("event_id").cast("string").alias("v")).groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "v")))).alias("report")
    )
    half = F.lit("2024-01-15").cast("timestamp_ntz")
    old = m(e.where(F.col("ts") < half)).withColumns({"first_seen": F.lit(AS_OF), "last_seen": F.lit(AS_OF)})
    out = H.upsert(old, m(e.where(F.col("ts") >= half)), ["user_id"], AS_OF, {"report": "merge_map"})
    return out.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("report")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("report"))


@query(
    "json_shape",
    "SELECT CASE event_id % 4 WHEN 0 THEN '{k}' WHEN 1 THEN 'array:2[{a,k}]' WHEN 2 THEN 'array:0' ELSE 'number' END AS shape, count(*) AS n FROM events GROUP BY 1"
)
def json_shape(spark, d):
    k = F.col("event_id") % 4
    doc = F.when(k == 0, F.col("props")).when(
        k == 1, F.concat(F.lit('[{"a": [1], "k": {"z": 1}}, '), F.col("props"), F.lit("]"))
    ).when(k == 2, F.lit("[]")).otherwise(F.col("event_id").cast("string"))
    return table(spark, d, "events").groupBy(W.json_shape(doc).alias("shape")).agg(F.count("*").alias("n"))


@query("state_keys", "SELECT o_orderkey, o_orderpriority || ':' || o_orderstatus || ':' || o_custkey AS key FROM orders")
def state_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", composite_key(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_custkey")).alias("key"))


@query(
    "progress",
    "SELECT source, CASE WHEN sum(n_chars) > 0 THEN round(CAST(sum(n_chars) FILTER (lang = 'en') AS DOUBLE) * 100 / sum(n_chars), 1) END AS pct FROM documents GROUP BY 1"
)
def progress(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))).alias("done"), F.sum("n_chars").alias("size"))
    return s.select("source", K.progress_pct(F.col("done"), F.col("size")).alias("pct"))


@query(
    "snapshot_export",
    f"SELECT count(*) AS tenders, {_d('o_totalprice')} AS value, (SELECT count(DISTINCT n_name) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) AS regions FROM orders"
)
def snapshot_export(spark, d):
    """The figures and the regions as one document, and what a reader finds in it."""
    kpis = table(spark, d, "orders").agg(F.count("*").alias("tenders"), K.money("o_totalprice").alias("value"))
    regions = K.by_region(tenders(spark, d), "n_name", "o_totalprice", "o_orderdate", "o_custkey", AS_OF)
    doc = C.snapshot(kpis, {"regions": regions})
    inner = F.get_json_object("document", "$.kpis")
    return doc.select(
        F.get_json_object(inner, "$.tenders").cast("long").alias("tenders"), F.get_json_object(inner, "$.value").cast("double").alias("value"),
        F.size(F.from_json(F.get_json_object("document", "$.regions"), "array<string>")).cast("long").alias("regions")
    )
