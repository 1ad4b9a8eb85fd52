"""Merges, change events and versions: orders as current tables, events as change stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tendril.catalog import query, table
from tendril.operators import history as H
from tendril.queries.market import _d

T0, T1 = datetime(2002, 1, 1), datetime(2002, 1, 2)


@query(
    "dedup_first",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS k FROM lineitem) WHERE k = 1"
)
def dedup_first(spark, d):
    return H.first_per_key(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"],
        [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")]
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _current(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderkey") % 4 != 0).withColumns({"first_seen": F.lit(T0), "last_seen": F.lit(T0)})


def _batch(spark, d):
    """A second reading of the orders: some are new, some have changed, some lack values."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").where(k % 3 != 0).withColumns(
        {
            "o_totalprice": F.when(k % 5 == 0, F.col("o_totalprice") + 10).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
            "o_orderpriority": F.when(k % 11 == 0, "9-NEW").otherwise(F.col("o_orderpriority"))
        }
    )


_TWO = """cur AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 0),
 bat AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
   CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice, o_orderdate, CASE WHEN o_orderkey % 11 = 0 THEN '9-NEW'
   ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0)"""


@query("upsert", f"""WITH {_TWO} SELECT coalesce(c.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN c.o_orderstatus
   ELSE b.o_orderstatus END AS o_orderstatus, CASE WHEN b.o_orderkey IS NULL THEN c.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
 c.o_orderkey IS NULL AS first_now, b.o_orderkey IS NOT NULL AS seen_now FROM cur c FULL JOIN bat b ON c.o_orderkey = b.o_orderkey""")
def upsert(spark, d):
    out = H.upsert(_current(spark, d), _batch(spark, d), ["o_orderkey"], T1)
    return out.select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("first_seen") == F.lit(T1)).alias("first_now"), (F.col("last_seen") == F.lit(T1)).alias("seen_now"))


@query("upsert_policy", f"""WITH {_TWO}
   SELECT coalesce(c.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, c.o_orderstatus) AS o_orderstatus, coalesce(c.o_totalprice, b.o_totalprice) AS o_totalprice,
 CASE WHEN c.o_orderkey IS NULL THEN b.o_orderpriority WHEN b.o_orderkey IS NULL THEN c.o_orderpriority
   ELSE c.o_orderpriority || ' ' || b.o_orderpriority END AS o_orderpriority FROM cur c FULL JOIN bat b ON c.o_orderkey = b.o_orderkey""")
def upsert_policy(spark, d):
    policy = {"o_orderstatus": "coalesce_new", "o_totalprice": "touch_only", "o_orderpriority": "append_text"}
    return H.upsert(_current(spark, d), _batch(spark, d), ["o_orderkey"], T1, policy).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("classify_changes", f"""WITH {_TWO} SELECT count(*) FILTER (c.o_orderkey IS NULL) AS inserted, count(*) FILTER (c.o_orderkey IS NOT NULL
   AND (c.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR c.o_totalprice IS DISTINCT FROM b.o_totalprice)) AS updated,
 count(*) FILTER (c.o_orderkey IS NOT NULL AND c.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AND c.o_totalprice IS NOT DISTINCT
   FROM b.o_totalprice) AS unchanged FROM bat b LEFT JOIN cur c ON c.o_orderkey = b.o_orderkey""")
def classify_changes(spark, d):
    return H.classify(_current(spark, d), _batch(spark, d), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


@query("tracked_events", f"""WITH {_TWO}, j AS (SELECT b.*, c.o_orderkey AS ck, c.o_orderstatus AS s0, c.o_totalprice AS p0, c.o_orderpriority AS q0
   FROM bat b LEFT JOIN cur c ON c.o_orderkey = b.o_orderkey)
 SELECT o_orderkey, 'NOVO_REGISTRO' AS type, NULL AS field FROM j WHERE ck IS NULL UNION ALL SELECT o_orderkey, 'SITUACAO_ALTERADA', 'o_orderstatus'
   FROM j WHERE ck IS NOT NULL AND o_orderstatus IS DISTINCT FROM s0
 UNION ALL SELECT o_orderkey, 'VALOR_ESTIMADO_ALTERADO', 'o_totalprice' FROM j WHERE ck IS NOT NULL AND o_totalprice IS DISTINCT FROM p0 UNION ALL
   SELECT o_orderkey, 'OBJETO_ALTERADO', 'o_orderpriority' FROM j WHERE ck IS NOT NULL AND o_orderpriority IS DISTINCT FROM q0""")
def tracked_events(spark, d):
    fields = {"o_orderstatus": "SITUACAO_ALTERADA", "o_totalprice": "VALOR_ESTIMADO_ALTERADO", "o_orderpriority": "OBJETO_ALTERADO"}
    return H.tracked_events(_current(spark, d), _batch(spark, d), ["o_orderkey"], fields).select("o_orderkey", "type", "field")


@query(
    "insert_if_absent",
    f"WITH {_TWO} SELECT o_orderkey, o_totalprice FROM cur UNION ALL SELECT o_orderkey, o_totalprice FROM bat WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cur)"
)
def insert_if_absent(spark, d):
    return H.insert_if_absent(_current(spark, d).drop("first_seen", "last_seen"), _batch(spark, d), ["o_orderkey"]).select("o_orderkey", "o_totalprice")


def _stream(spark, d):
    """Events as documents of a user: the type, the value in tenths, and k from the properties where it is even."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    data = F.map_concat(
        F.create_map(F.lit("type"), F.col("event_type"), F.lit("level"), F.floor(F.col("value") / 20).cast("string")),
        F.when(k.cast("int") % 2 == 0, F.create_map(F.lit("k"), k)).otherwise(F.create_map().cast("map<string,string>"))
    )
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 50 != 7, data).alias("data"))


def _state(spark, d):
    """What is known before: a document for every second user."""
    u = table(spark, d, "events").select(F.col("user_id").alias("key")).distinct().where(F.col("key") % 2 == 0)
    return u.select("key", F.create_map(F.lit("type"), F.lit("view"), F.lit("level"), F.lit("1.0")).alias("data"), F.lit(3).cast("long").alias("version"))


_DIFF = """docs AS (SELECT user_id AS key, event_id AS seq, event_type, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS level, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 50 <> 7),
 f AS (SELECT key, seq, 'type' AS field, event_type AS value FROM docs UNION ALL SELECT key, seq, 'level', level FROM docs UNION ALL
   SELECT key, seq, 'k', k FROM docs WHERE CAST(k AS INT) % 2 = 0
  UNION ALL SELECT DISTINCT user_id, -1, 'type', 'view' FROM events WHERE user_id % 2 = 0 UNION ALL SELECT DISTINCT user_id, -1, 'level', '1.0' FROM events WHERE user_id % 2 = 0),
 g AS (SELECT *, lag(value) OVER w AS old_value, row_number() OVER w AS nth FROM f WINDOW w AS (PARTITION BY key, field ORDER BY seq)),
 h AS (SELECT *, seq >= 0 AND (nth = 1 OR NOT (value IS NOT DISTINCT
   FROM old_value OR coalesce(TRY_CAST(value AS DOUBLE) = TRY_CAST(old_value AS DOUBLE), false))) AS changed FROM g),
 r AS (SELECT key, seq, key % 2 = 0 AS stored, row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AND key % 2 <> 0 AS is_new FROM docs),
 s AS (SELECT r.*, is_new OR EXISTS (SELECT 1 FROM h WHERE h.key = r.key AND h.seq = r.seq AND changed) AS counts FROM r),
 v AS (SELECT *, CASE WHEN stored THEN 3 ELSE 0 END + sum(CASE WHEN counts THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq) AS after FROM s)"""


@query("state_diff_events", f"""WITH {_DIFF} SELECT key, seq, 'NOVO_REGISTRO' AS type, NULL AS old_value, NULL AS new_value FROM s WHERE is_new
 UNION ALL SELECT h.key, h.seq, upper(field) || '_ALTERADO', old_value, value FROM h JOIN s ON s.key = h.key AND s.seq = h.seq WHERE changed AND NOT is_new""")
def state_diff_events(spark, d):
    return H.state_diff(_state(spark, d), _stream(spark, d))[0].select("key", "seq", "type", "old_value", "new_value")


@query("state_current", f"""WITH {_DIFF}, l AS (SELECT key, string_agg(field || '=' || value, ',' ORDER BY field) AS data
   FROM (SELECT key, field, arg_max(value, seq) AS value FROM f GROUP BY 1, 2) GROUP BY 1)
 SELECT key, data, CAST(coalesce(after, 3) AS BIGINT) AS version FROM l LEFT JOIN (SELECT key, max(after) AS after FROM v GROUP BY 1) USING (key)""")
def state_current(spark, d):
    after = H.state_diff(_state(spark, d), _stream(spark, d))[1]
    return after.select("key", F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("data"), "version")


@query("version_history", f"""WITH {_DIFF}, c AS (SELECT key, seq, after FROM v WHERE counts AND NOT is_new),
 x AS (SELECT c.key, c.seq, c.after, f.field, arg_max(f.value, f.seq) AS value FROM c JOIN f ON f.key = c.key AND f.seq < c.seq GROUP BY ALL)
 SELECT key, seq AS closed_by, string_agg(field || '=' || value, ',' ORDER BY field) AS data, CAST(after - 1 AS BIGINT) AS version FROM x GROUP BY key, seq, after""")
def version_history(spark, d):
    closed = H.state_diff(_state(spark, d), _stream(spark, d))[2]
    return closed.select(
        "key", "closed_by",
        F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("data"),
        "version"
    )


@query(
    "patch_rows",
    """SELECT s_suppkey, CASE WHEN p.k IS NULL THEN s_name ELSE s_name || ' ' || p.note END AS s_name, coalesce(p.bal, s_acctbal) AS s_acctbal FROM supplier LEFT JOIN (SELECT c_custkey AS k, c_mktsegment AS note, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer WHERE c_custkey % 3 = 0) p ON p.k = s_suppkey"""
)
def patch_rows(spark, d):
    p = table(spark, d, "customer").where(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").alias("s_suppkey"), F.col("c_mktsegment").alias("s_name"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("s_acctbal")
    )
    return H.patch(table(spark, d, "supplier"), p, ["s_suppkey"], {"s_name": "append_text", "s_acctbal": "coalesce_new"}).select("s_suppkey", "s_name", "s_acctbal")


@query(
    "recode_status",
    f"SELECT CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'PARTIAL' WHEN o_orderstatus = 'F' THEN 'COMPLETE' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n, {_d('o_totalprice')} AS total FROM orders GROUP BY 1"
)
def recode_status(spark, d):
    s = F.col("o_orderstatus")
    out = H.recode(table(spark, d, "orders"), "o_orderstatus", [((s == "P") & (F.col("o_totalprice") > 200000), "PARTIAL"), (s == "F", "COMPLETE")])
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
