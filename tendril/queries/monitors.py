"""Search and monitors: orders with the names of their parts as tenders, lineitem as items and awards."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendril.catalog import query, roomy, stored, table
from tendril.functions.text import effective_terms, fold_accents, text_matches, text_matches_phrase
from tendril.operators import monitors as M
from tendril.operators.market import with_price_in, without_any
from tendril.queries.market import TENDERS, _d, tenders

AS_OF = datetime(2000, 6, 1)

#: The dictionary flavour of folding; ``strip_accents`` leaves these letters.
_FOLD = "strip_accents(lower(coalesce({}, '')))"
for _a, _b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ħ", "h"), ("ı", "i"), ("ŧ", "t")):
    _FOLD = f"replace({_FOLD}, '{_a}', '{_b}')"

_LISTS = ("include", "exclude", "approved", "states", "cities", "agencies_in", "agencies_out", "modalities", "statuses", "codes", "suppliers")


def _rule(monitor_id: int, **given) -> dict:
    fields = [f.split()[0] for f in M.RULE.split(", ")]
    return {f: [] if f in _LISTS else None for f in fields} | {"monitor_id": monitor_id} | given


#: The rules of the queries: every condition is used by some.
RULES = [
    _rule(1, include=["Ring SMALL"], exclude=["gizmo"]),
    _rule(2, include=["red widget", "hot gear"], value_min=100000.0, value_max=400000.0),
    _rule(3, include=["x", "blue bolt"], approved=["cold"], modalities=["%urgent", "2-h%"], statuses=["o", "P%", "origem f"]),
    _rule(4, include=["b_lt"], agencies_out=["Customer#000000001"], opens_within_days=400, registers=False),
    _rule(5, include=["gear"], price_min=1000.0, price_max=1010.0, suppliers=["7", "9"], states=["NATION_7", "NATION_12", "NATION_3"]),
    _rule(6, include=["WIDGÉT"], codes=["3", "5", "11"], contract_days=30, plans=False),
    _rule(7, include=["a"], cities=["customer#00000000_", "%0017"], suppliers=["1"], deserted=False),
    _rule(8, statuses=["%"], agencies_in=["Customer#000000011", "Customer#000000013"], failed=False, contracts=False),
    _rule(9, include=["gear", "!"], agencies_in=["Customer#000000005", "Brand#12", "Brand#3"]),
    _rule(10, include=["- -"]),
]


def rules(spark):
    return spark.createDataFrame([tuple(r.values()) for r in RULES], M.RULE)


def _records(spark, d):
    names = table(spark, d, "lineitem").join(
        table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")
    ).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("text"))
    t = tenders(spark, d).join(names, F.col("o_orderkey") == F.col("l_orderkey"))
    return t.select(
        F.col("o_orderkey").alias("key"), "text", F.col("n_name").alias("state"), F.col("c_name").alias("city"), F.col("c_name").alias("agency"), F.col("o_orderpriority").alias("modality"),
        F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderstatus")).alias("status"), F.concat(F.lit("Origem "), F.col("o_orderstatus")).alias("status_source"),
        F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("closes"), F.col("o_orderdate").alias("published"),
    )


def _kept(spark, d):
    """The tenders with their folded texts, written once for all that reads them."""
    return stored(_records(spark, d).withColumn("_folded", fold_accents(F.col("text"), True)), "records")


def _items(spark, d):
    return table(spark, d, "lineitem").where(F.col("l_quantity") > 0).select(
        F.col("l_orderkey").alias("key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_partkey").alias("code")
    )


def matches(spark, d, records=None):
    return M.match_records(_records(spark, d) if records is None else records, _items(spark, d), rules(spark), AS_OF)


def _listed(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _effective(r: dict) -> list[str]:
    return [t for t in [*r["include"], *r["approved"]] if len(t.strip()) > 1]


def _words_sql(terms, column):
    out = []
    for t in terms:
        ws = [w for w in t.lower().replace("é", "e").split() if len(w) > 1]
        if ws:
            out.append("(" + " AND ".join(f"{column} LIKE '%{w}%'" for w in ws) + ")")
    return "(" + (" OR ".join(out) or "false") + ")"


def _rule_sql(r: dict, records: str, now: str = "TIMESTAMP '2000-06-01'") -> str:
    c = ["true"]
    if terms := _effective(r):
        c.append(_words_sql(terms, "folded"))
    if r["exclude"]:
        c.append("NOT " + _words_sql(r["exclude"], "folded"))
    for name, column in (("modalities", "modality"), ("cities", "city"), ("statuses", "coalesce(status, status_source, '')")):
        if r[name]:
            c.append("(" + " OR ".join(f"{column} ILIKE '{x}'" for x in r[name]) + ")")
    for name, column in (("states", "state"), ("agencies_in", "agency")):
        if r[name]:
            c.append(f"{column} IN {_listed(r[name])}")
    if r["agencies_out"]:
        c.append(f"(agency IS NULL OR agency NOT IN {_listed(r['agencies_out'])})")
    if r["value_min"] is not None:
        c.append(f"value >= {r['value_min']}")
    if r["value_max"] is not None:
        c.append(f"value <= {r['value_max']}")
    if r["opens_within_days"] is not None:
        c.append(f"closes BETWEEN {now} AND {now} + INTERVAL {r['opens_within_days']} DAY")
    if r["price_min"] is not None:
        c.append(f"key IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 0 AND l_extendedprice / l_quantity BETWEEN {r['price_min']} AND {r['price_max']})")
    if r["codes"]:
        c.append(f"key IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 0 AND CAST(l_partkey AS VARCHAR) IN {_listed(r['codes'])})")
    return f"SELECT CAST({r['monitor_id']} AS BIGINT) AS monitor_id, * FROM {records} WHERE {' AND '.join(c)}"


def _all_rules(records: str) -> str:
    return " UNION ALL ".join(_rule_sql(r, records) for r in RULES)


_TEXTS = f"""texts AS (SELECT l_orderkey, string_agg(DISTINCT p_name, ' ' ORDER BY p_name) AS text FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
 records AS (SELECT o_orderkey AS key, text, {_FOLD.format('text')} AS folded, n_name AS state, c_name AS city, c_name AS agency, o_orderpriority AS modality, CASE WHEN o_orderkey % 19 <> 0 THEN o_orderstatus END AS status, 'Origem ' || o_orderstatus AS status_source,
  o_totalprice AS value, o_orderdate AS closes FROM {TENDERS} JOIN texts ON o_orderkey = l_orderkey)"""
_RECORDS = f"{_TEXTS}, matches AS ({_all_rules('records')})"


@query("monitor_matches", f"WITH {_RECORDS} SELECT monitor_id, key, status, value FROM matches")
def monitor_matches(spark, d):
    return matches(spark, d).select("monitor_id", "key", "status", "value")


def _awards(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("item"), F.col("l_suppkey").alias("supplier"),
        F.col("l_extendedprice").alias("award_value"),
        F.when(F.col("l_quantity") > 0, F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )


def _as_text(column: str) -> Column:
    """A map as text, ascending by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def _map_sql(name: str, by: str, table_: str = "matches") -> str:
    return f"{name} AS (SELECT monitor_id, string_agg(k || '=' || n, ',' ORDER BY k) AS {name} FROM (SELECT monitor_id, {by} AS k, count(*) AS n FROM {table_} GROUP BY 1, 2) WHERE k IS NOT NULL GROUP BY 1)"


@query("monitor_baseline", f"""WITH {_RECORDS}, per AS (SELECT monitor_id, round(avg(n), 4) AS competition
   FROM (SELECT monitor_id, key, count(DISTINCT l_suppkey) AS n FROM matches JOIN lineitem ON l_orderkey = key GROUP BY 1, 2) GROUP BY 1),
 p AS (SELECT monitor_id, l_extendedprice / l_quantity AS u FROM matches JOIN lineitem ON l_orderkey = key WHERE l_quantity > 0 AND l_extendedprice / l_quantity > 0),
 q AS (SELECT monitor_id, count(*) AS prices, round(quantile_cont(u, 0.25), 4) AS p25, round(quantile_cont(u, 0.5), 4) AS median_price, round(quantile_cont(u, 0.75), 4) AS p75 FROM p GROUP BY 1),
 ag AS (SELECT monitor_id, agency, count(*) AS n, row_number() OVER (PARTITION BY monitor_id ORDER BY count(*) DESC, agency) AS place FROM matches
   WHERE agency IS NOT NULL GROUP BY 1, 2),
 agencies AS (SELECT monitor_id, string_agg(agency || '=' || n, ',' ORDER BY agency) AS agencies FROM ag WHERE place <= 10
   GROUP BY 1), {_map_sql('by_month', "strftime(closes, '%Y-%m')")}, {_map_sql('by_state', 'state')}
 SELECT m.monitor_id, count(*) AS sample, strftime(min(closes), '%Y-%m-%d') AS first, strftime(max(closes), '%Y-%m-%d') AS last, {_d('value')} AS total_value, round(quantile_cont(value, 0.5) FILTER (value > 0), 4) AS median_value,
 count(*) FILTER (lower(coalesce(status, status_source)) LIKE '%desert%') AS deserted, count(*) FILTER (lower(coalesce(status, status_source)) LIKE '%fracass%') AS failed, any_value(competition) AS competition,
 any_value(prices) AS prices, any_value(p25) AS p25, any_value(median_price) AS median_price, any_value(p75) AS p75, any_value(by_month) AS by_month, any_value(by_state) AS by_state, any_value(agencies) AS agencies
 FROM matches m LEFT JOIN per USING (monitor_id) LEFT JOIN q USING (monitor_id) LEFT JOIN by_month USING (monitor_id) LEFT
   JOIN by_state USING (monitor_id) LEFT JOIN agencies USING (monitor_id) GROUP BY 1""")
def monitor_baseline(spark, d):
    b = M.baseline(matches(spark, d), _awards(spark, d)).withColumn("median_value", F.round("median_value", 4))
    return b.withColumns({c: _as_text(c) for c in ("by_month", "by_state", "agencies")}).drop("method")


@query("monitor_competitors", f"""WITH {_RECORDS}, s AS (SELECT monitor_id, l_suppkey AS supplier, count(*) AS awards, {_d('l_extendedprice')} AS total_value FROM matches JOIN lineitem ON l_orderkey = key GROUP BY 1, 2)
 SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor_id ORDER BY total_value DESC NULLS LAST, supplier) AS INT) AS place FROM s) WHERE place <= 10""")
def monitor_competitors(spark, d):
    return M.competitors(matches(spark, d), _awards(spark, d))


def _changed(df):
    """The same tenders some days later: prices, closing days, states, agencies and awards of some have changed."""
    k = F.col("key")
    return df.withColumns({
        "value": F.when(k % 5 == 0, F.col("value") * 1.25).otherwise(F.col("value")),
        "closes": F.when(k % 7 == 0, F.col("closes") + F.expr("interval 10 days")).otherwise(F.col("closes")),
        "status": F.when(k % 11 == 0, "FRACASSADA").when(k % 13 == 0, "deserta").otherwise(F.col("status")),
        "agency": F.when(k % 23 == 0, F.concat("agency", F.lit("*"))).otherwise(F.col("agency")),
        "awarded": F.when(k % 17 == 0, F.col("value")),
    })


def _nothing(spark):
    """A match table without rows."""
    types = {"value": "double", "awarded": "double", "closes": "timestamp_ntz"}
    fields = ["monitor_id long", "key long", *[f"{c} timestamp" for c in ("first_seen", "last_seen", "last_checked")], *[f"{c} {types.get(c, 'string')}" for c in M.SNAPSHOT]]
    return spark.createDataFrame([], ", ".join(fields))


LATER = datetime(2000, 6, 2)


def _evaluated(spark, d, records=None):
    """The match table and the alerts after two readings: a silent one of some tenders, and one of all.

    The tenders are written once for both readings, and what each finds once for all that asks for it.
    """
    records = _kept(spark, d) if records is None else records
    found = lambda records: stored(M.snapshot(M.match_records(records, _items(spark, d), rules(spark), AS_OF)), "found")
    state, _ = M.remember(_nothing(spark), found(records.where(F.col("key") % 3 != 0)), rules(spark), AS_OF, first_run=True)
    return M.remember(state, found(_changed(records)), rules(spark), LATER)


def _money(v: str) -> str:
    return f"coalesce('R$ ' || replace(format('{{:,}}', CAST(round({v}) AS BIGINT)), ',', '.'), 'valor não informado')"


def _alerts_sql(now: str) -> str:
    soon = f"c1 < TIMESTAMP '{now}' + INTERVAL 48 HOUR"
    st = "lower(coalesce(s1, status_source, ''))"
    watch = {name: f"monitor_id NOT IN ({', '.join(str(r['monitor_id']) for r in RULES if r[name] is False)})" for name in ("deserted", "failed")}
    deserted = f"({watch['deserted']} AND {st} LIKE '%desert%')"
    return f"""{_RECORDS}, records2 AS (SELECT * REPLACE (CASE WHEN key % 5 = 0 THEN value * 1.25 ELSE value END AS value,
   CASE WHEN key % 7 = 0 THEN closes + INTERVAL 10 DAY ELSE closes END AS closes,
  CASE WHEN key % 11 = 0 THEN 'FRACASSADA' WHEN key % 13 = 0 THEN 'deserta' ELSE status END AS status, CASE WHEN key % 23 = 0 THEN agency || '*'
   ELSE agency END AS agency), key % 17 = 0 AND value IS NOT NULL AS aw FROM records),
 matches2 AS ({_all_rules('records2')}), before AS (SELECT monitor_id, key, status AS s0, value AS v0, closes AS c0, agency AS a0 FROM matches WHERE key % 3 <> 0),
 later AS (SELECT n.monitor_id, n.key, n.state, n.status AS s1, n.status_source, n.value AS v1, n.closes AS c1, n.agency AS a1, aw, s0, v0, c0, a0, b.key IS NULL AS is_new FROM matches2 n LEFT JOIN before b USING (monitor_id, key)),
 alerts AS (SELECT monitor_id, key, 'NEW_PROCUREMENT' AS type, CASE WHEN {soon} THEN 'critica' WHEN v1 >= 1000000 THEN 'alta'
   ELSE 'media' END AS importance, {_money('v1')} || coalesce(' em ' || state, '') AS new_text FROM later WHERE is_new
 UNION ALL SELECT monitor_id, key, 'DESERTED', 'media', {st} FROM later WHERE is_new AND {deserted} UNION ALL
   SELECT monitor_id, key, 'FAILED', 'media', {st} FROM later WHERE is_new AND NOT {deserted} AND {watch['failed']} AND {st} LIKE '%fracass%'
 UNION ALL SELECT monitor_id, key, 'PRICE_CHANGE', CASE WHEN v0 > 0 AND abs(round((v1 - v0) / v0 * 100, 1)) >= 20 THEN 'alta'
   ELSE 'media' END, {_money('v1')} FROM later WHERE NOT is_new AND v1 IS DISTINCT FROM v0
 UNION ALL SELECT monitor_id, key, 'DEADLINE_CHANGED', CASE WHEN {soon} THEN 'critica' ELSE 'alta' END, strftime(c1, '%Y-%m-%d') FROM later
   WHERE NOT is_new AND c1 IS DISTINCT FROM c0
 UNION ALL SELECT monitor_id, key, 'PROCUREMENT_UPDATED', 'media', s1 FROM later WHERE NOT is_new AND (s1 IS DISTINCT FROM s0 OR aw))"""


def fleet_sql(evaluated: dict[int, tuple[int, ...]], ticks: list[datetime]) -> str:
    """Alerts by tick of monitors that are evaluated at some ticks, the first time silently, on the records as they are then.

    Tick 0 has the records whose key 3 does not divide, as they were first; tick 1 brings the even ones as they are later, tick 2 the others.
    """
    value, closes = "CASE WHEN key % 5 = 0 THEN value * 1.25 ELSE value END", "CASE WHEN key % 7 = 0 THEN closes + INTERVAL 10 DAY ELSE closes END"
    status, agency = "CASE WHEN key % 11 = 0 THEN 'FRACASSADA' WHEN key % 13 = 0 THEN 'deserta' ELSE status END", "CASE WHEN key % 23 = 0 THEN agency || '*' ELSE agency END"
    later = f"SELECT * REPLACE ({value} AS value, {closes} AS closes, {status} AS status, {agency} AS agency), key % 17 = 0 AND value IS NOT NULL AS aw FROM records"
    first = "SELECT *, false AS aw FROM records"
    bases = [f"{first} WHERE key % 3 <> 0", f"{later} WHERE key % 2 = 0 UNION ALL {first} WHERE key % 2 = 1 AND key % 3 <> 0", later]
    now = [f"TIMESTAMP '{t}'" for t in ticks]
    rules_ = {r["monitor_id"]: r for r in RULES}
    hits = " UNION ALL ".join(
        f"SELECT {n} AS tick, {now[n]} AS now, {n == when[0]} AS silent, * FROM ({_rule_sql(rules_[k], f'base{n}', now[n])})" for k,
        when in evaluated.items() for n in when
    )
    watch = {name: f"monitor_id NOT IN ({', '.join(str(r['monitor_id']) for r in RULES if r[name] is False)})" for name in ("deserted", "failed")}
    st, soon = "lower(coalesce(status, status_source, ''))", "closes < now + INTERVAL 48 HOUR"
    deserted = f"({watch['deserted']} AND {st} LIKE '%desert%')"
    b = ", ".join(f"base{n} AS ({x})" for n, x in enumerate(bases))
    before = ", ".join(f"lag({c}) OVER w AS {o}" for c, o in (("status", "s0"), ("value", "v0"), ("closes", "c0"), ("aw", "a0")))
    return f"""WITH {_TEXTS}, {b}, hits AS ({hits}), later AS (SELECT *, lag(key) OVER w IS NULL AS is_new, {before} FROM hits
   WINDOW w AS (PARTITION BY monitor_id, key ORDER BY tick)),
 alerts AS (SELECT tick, monitor_id, key, 'NEW_PROCUREMENT' AS type, CASE WHEN {soon} THEN 'critica' WHEN value >= 1000000 THEN 'alta'
   ELSE 'media' END AS importance FROM later WHERE is_new AND NOT silent
 UNION ALL SELECT tick, monitor_id, key, 'DESERTED', 'media' FROM later WHERE is_new AND {deserted} UNION ALL
   SELECT tick, monitor_id, key, 'FAILED', 'media' FROM later WHERE is_new AND NOT {deserted} AND {watch['failed']} AND {st} LIKE '%fracass%'
 UNION ALL SELECT tick, monitor_id, key, 'PRICE_CHANGE', CASE WHEN v0 > 0 AND abs(round((value - v0) / v0 * 100, 1)) >= 20 THEN 'alta'
   ELSE 'media' END FROM later WHERE NOT is_new AND value IS DISTINCT FROM v0
 UNION ALL SELECT tick, monitor_id, key, 'DEADLINE_CHANGED', CASE WHEN {soon} THEN 'critica' ELSE 'alta' END FROM later WHERE NOT is_new AND closes IS DISTINCT FROM c0
 UNION ALL SELECT tick, monitor_id, key, 'PROCUREMENT_UPDATED', 'media' FROM later WHERE NOT is_new AND (status IS DISTINCT FROM s0 OR aw IS DISTINCT
   FROM a0)) SELECT CAST(tick AS INT) AS tick, monitor_id, key, type, importance FROM alerts"""


_ALERTS = _alerts_sql("2000-06-01")
_ALERTS_LATER = _alerts_sql("2000-06-02")


@query("monitor_alerts", f"WITH {_ALERTS_LATER} SELECT monitor_id, key, type, importance, new_text FROM alerts")
def monitor_alerts(spark, d):
    return _evaluated(spark, d)[1].select("monitor_id", "key", "type", "importance", "new_text")


def _title_sql() -> str:
    """Titles of the second reading's alerts, and of all winners on matched tenders."""
    t = M.TITLES
    pct = "CAST(round((v1 - v0) / v0 * 100, 1) AS DECIMAL(28, 1))"
    by_type = {
        "NEW_PROCUREMENT": f"'{t['NEW_PROCUREMENT']}' || {_money('v1')} || ' encontrada' || coalesce(' em ' || state, '')", "DESERTED": f"'{t['DESERTED']}'", "FAILED": f"'{t['FAILED']}'",
        "PRICE_CHANGE": f"'{t['PRICE_CHANGE']}' || coalesce(CASE WHEN v0 > 0 THEN ' em ' || CASE WHEN {pct} > 0 THEN '+' ELSE '' END || {pct} || '%' END, '')", "DEADLINE_CHANGED": f"'{t['DEADLINE_CHANGED']}'",
        "PROCUREMENT_UPDATED": f"'{t['PROCUREMENT_UPDATED']}' || coalesce(': ' || CASE WHEN s1 IS DISTINCT FROM s0 THEN s1 END, '')",
    }
    said = " ".join(f"WHEN '{k}' THEN {v}" for k, v in by_type.items())
    winners = f"SELECT DISTINCT monitor_id, key || ':' || l_linenumber || ':' || l_suppkey, 'NEW_WINNER', '{t['NEW_WINNER']}' || coalesce(CASE WHEN l_suppkey % 10 <> 3 THEN s_name END, 'Fornecedor') || ' homologado em processo deste monitor' FROM matches JOIN lineitem ON l_orderkey = key JOIN supplier ON s_suppkey = l_suppkey"
    return f"SELECT a.monitor_id, CAST(a.key AS VARCHAR) AS key, type, CASE type {said} END AS title FROM alerts a JOIN later l ON l.monitor_id = a.monitor_id AND l.key = a.key UNION ALL {winners}"


@query("monitor_alert_titles", f"WITH {_ALERTS_LATER} {_title_sql()}")
def monitor_alert_titles(spark, d):
    """What the alerts of the second reading are called, and those of the winners of all matched tenders, some of which have no name."""
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.when(F.col("s_suppkey") % 10 != 3, F.col("s_name")).alias("supplier_name"))
    with roomy(spark, _awards(spark, d).count()):
        records = _kept(spark, d)
        won = M.award_alerts(matches(spark, d, records), _awards(spark, d).join(names, "supplier"), rules(spark))
        alerts = M.told(_evaluated(spark, d, records)[1]).unionByName(won)
        return stored(M.titled(alerts, LATER).select("monitor_id", "key", "type", "title"), "titles")


@query("monitor_memory", f"""WITH {_ALERTS_LATER}
   SELECT coalesce(l.monitor_id, b.monitor_id) AS monitor_id, coalesce(l.key, b.key) AS key, l.key IS NOT NULL AND (is_new OR v1 IS DISTINCT
   FROM l.v0 OR c1 IS DISTINCT FROM l.c0 OR s1 IS DISTINCT FROM l.s0 OR a1 IS DISTINCT FROM l.a0 OR aw) AS moved, l.key IS NOT NULL AS checked
 FROM later l FULL JOIN before b ON l.monitor_id = b.monitor_id AND l.key = b.key""")
def monitor_memory(spark, d):
    """Which matches moved at the second reading, as anything that is remembered of them changed, and which were seen."""
    state, _ = _evaluated(spark, d)
    at = F.lit(LATER).cast("timestamp")
    return state.select("monitor_id", "key", (F.col("last_seen") == at).alias("moved"), (F.col("last_checked") == at).alias("checked"))


def _raised(alerts):
    """Alerts with a time and a mark: some are older than a day, some have been read."""
    k = F.col("key")
    return alerts.withColumns({"raised_at": F.lit(LATER) - F.make_dt_interval(days=F.when(k % 2 == 0, 3).otherwise(0)), "read": k % 5 == 0})


_RAISED = "raised AS (SELECT *, TIMESTAMP '2000-06-02' - CASE WHEN key % 2 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END AS raised_at, key % 5 = 0 AS read FROM alerts)"


@query("monitor_cards", f"""WITH {_ALERTS_LATER}, {_RAISED}, a AS (SELECT monitor_id, count(*) AS alerts, count(*) FILTER (raised_at > TIMESTAMP '2000-06-01') AS last_day, count(*) FILTER (importance IN ('alta', 'critica') AND NOT read) AS unread_high FROM raised GROUP BY 1),
 held AS (SELECT coalesce(l.monitor_id, b.monitor_id) AS monitor_id, CASE WHEN l.key IS NULL THEN b.c0 ELSE c1 END AS closes FROM later l FULL
   JOIN before b ON l.monitor_id = b.monitor_id AND l.key = b.key)
 SELECT monitor_id, count(*) AS matches, count(*) FILTER (closes > TIMESTAMP '2000-06-02') AS open, coalesce(any_value(alerts), 0) AS alerts, coalesce(any_value(last_day), 0) AS last_day, coalesce(any_value(unread_high), 0) AS unread_high FROM held LEFT JOIN a USING (monitor_id) GROUP BY 1""")
def monitor_cards(spark, d):
    state, alerts = _evaluated(spark, d)
    return M.cards(state, _raised(alerts), LATER)


_MONITORS = "monitors AS (SELECT user_id AS monitor_id, max(ts) AS next_run, count(*) FILTER (event_type = 'error') < 20 AS active, CAST(10 + user_id % 3 AS INT) AS refresh_minutes FROM events GROUP BY 1)"


def _monitors(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("monitor_id")).agg(
        F.max("ts").alias("next_run"), (F.count_if(F.col("event_type") == "error") < 20).alias("active")
    ).withColumn("refresh_minutes", (F.col("monitor_id") % 3 + 10).cast("int"))


@query("fleet_stats", f"""WITH {_ALERTS_LATER}, {_RAISED}, {_MONITORS} SELECT (SELECT count(*) FROM monitors) AS monitors, (SELECT count(*)
   FROM monitors WHERE active) AS active, (SELECT strftime(min(next_run), '%Y-%m-%d %H:%M:%S') FROM monitors WHERE active) AS next_run,
 (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM raised) AS alerts, (SELECT count(*) FROM raised WHERE raised_at > TIMESTAMP '2000-06-01') AS last_day""")
def fleet_stats(spark, d):
    records = _kept(spark, d)
    f = M.fleet_stats(_monitors(spark, d), matches(spark, d, records), _raised(_evaluated(spark, d, records)[1]), LATER)
    return f.withColumn("next_run", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss"))


@query(
    "reschedule",
    f"WITH {_MONITORS} SELECT monitor_id, strftime(CASE WHEN monitor_id % 4 = 0 THEN next_run WHEN monitor_id % 4 = 1 THEN TIMESTAMP '2024-02-01' + INTERVAL 30 MINUTE ELSE TIMESTAMP '2024-02-01' + refresh_minutes * INTERVAL 1 MINUTE END, '%Y-%m-%d %H:%M:%S') AS next_run FROM monitors"
)
def reschedule(spark, d):
    m = _monitors(spark, d)
    done = m.where(F.col("monitor_id") % 4 != 0).select("monitor_id", (F.col("monitor_id") % 4 != 1).alias("ok"))
    return M.reschedule(m, done, datetime(2024, 2, 1)).select("monitor_id", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("new_since", "SELECT event_id, event_type FROM events WHERE event_id > 9000")
def new_since(spark, d):
    return M.new_since(table(spark, d, "events"), "event_id", 9000).select("event_id", "event_type")


@query("award_alerts", f"""WITH {_RECORDS}
   SELECT DISTINCT monitor_id, key || ':' || l_linenumber || ':' || coalesce(CAST(s AS VARCHAR), '?') AS key, 'NEW_WINNER' AS type,
   CASE WHEN monitor_id = 5 AND s IN (7, 9) OR monitor_id = 7 AND s = 1 THEN 'alta' ELSE 'media' END AS importance
 FROM matches JOIN (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 10 <> 3 THEN l_suppkey END AS s FROM lineitem) ON l_orderkey = key WHERE l_linenumber <> 1""")
def award_alerts(spark, d):
    """Winners that are not remembered yet; those of the first items are.  Matches are written once, and shuffled into as many parts as the lines ask for."""
    a = _awards(spark, d).withColumn("supplier", F.when(F.col("supplier") % 10 != 3, F.col("supplier")))
    with roomy(spark, a.count()):
        m = stored(matches(spark, d, _kept(spark, d)).select("monitor_id", "key"), "matches")
        memory, _ = M.raise_once(spark.createDataFrame([], M.MEMORY), M.award_alerts(m, a.where(F.col("item") == 1), rules(spark)), "award", AS_OF, first_run=True)
        return stored(M.raise_once(memory, M.award_alerts(m, a, rules(spark)), "award", AS_OF)[1].drop("details"), "alerts")


def _of_contracts(r: dict) -> str:
    states = f" AND state IN {_listed(r['states'])}" if r["states"] else ""
    suppliers = _listed(r["suppliers"]) if r["suppliers"] else "(NULL)"
    return f"SELECT CAST({r['monitor_id']} AS BIGINT) AS monitor_id, * FROM c WHERE days_left <= {r['contract_days'] or 180}{states} AND ({_words_sql(_effective(r), 'folded')} OR coalesce(supplier IN {suppliers}, false)) AND NOT {_words_sql(r['exclude'], 'folded')}"


@query("expiring_contracts", f"""WITH c AS (SELECT l_orderkey || '/' || l_linenumber AS key, n_name AS state, {_FOLD.format('p_name')} AS folded, CAST(l_suppkey AS VARCHAR) AS supplier, CAST(date_diff('day', DATE '2000-06-01', CAST(l_shipdate AS DATE)) AS INT) AS days_left FROM lineitem JOIN part ON p_partkey = l_partkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '2000-06-01'
   AND DATE '2000-11-28'), m AS (SELECT DISTINCT monitor_id, key, days_left FROM ({' UNION ALL '.join(_of_contracts(r) for r in RULES if r['contracts'] is not False)}))
 SELECT monitor_id, key, 'CONTRACT_EXPIRING' AS type, min(days_left) AS days_left, CASE WHEN min(days_left) <= 30 THEN 'alta'
   ELSE 'media' END AS importance FROM m GROUP BY 1, 2""")
def expiring_contracts(spark, d):
    """Contracts that end soon, each once a monitor: the same key is one contract, of the nearest end."""
    where = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    c = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(where, F.col("s_suppkey") == F.col("l_suppkey"))
    c = c.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), F.col("p_name").alias("text"), F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("ends"), F.col("n_name").alias("state")
    )
    found = M.expiring_contract_alerts(c, rules(spark), AS_OF)
    nearest = found.groupBy("monitor_id", "key", "type").agg(F.min_by(F.struct("days_left", "importance"), "days_left").alias("x")).select("monitor_id", "key", "type", "x.*")
    return M.raise_once(spark.createDataFrame([], M.MEMORY), nearest, "contract", AS_OF)[1]


@query(
    "suggest_expansions",
    """SELECT lower(left(trim(p_name), 80)) AS label, count(*) AS n, max(p_partkey) AS code FROM part WHERE strip_accents(lower(p_name)) LIKE '%red%' OR strip_accents(lower(p_name)) LIKE '%gear%' GROUP BY 1 ORDER BY n DESC, label LIMIT 20"""
)
def suggest_expansions(spark, d):
    return M.suggest_expansions(table(spark, d, "part"), ["red", "gear"], "p_name", "p_partkey")


_Q = "TION êr"
_HIT = "{0} IS NOT NULL AND " + " AND ".join(_FOLD.replace("{}", "{0}") + f" LIKE '%{w}%'" for w in ("tion", "er"))


@query("text_match", f"SELECT doc_id, {_HIT.format('text')} AS all_words, coalesce(lower(text) LIKE '%tion êr%', false) AS phrase FROM documents")
def text_match(spark, d):
    terms = F.array(F.lit(_Q), F.lit("q"))
    return table(spark, d, "documents").select(
        "doc_id", text_matches(F.col("text"), terms).alias("all_words"), text_matches_phrase(F.col("text"), F.array(F.lit(_Q))).alias("phrase")
    )


@query("search_ranked", f"""SELECT * FROM (SELECT 'documents' AS origin, doc_id AS key, n_chars AS rank FROM documents WHERE {_HIT.format('text')}
   ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20)
 UNION ALL SELECT * FROM (SELECT 'pages', page_id, length(html) FROM pages WHERE {_HIT.format('html')} ORDER BY length(html) DESC NULLS LAST, page_id LIMIT 20)""")
def search_ranked(spark, d):
    return M.search(
        {"documents": (table(spark, d, "documents"), "doc_id", "text", F.col("n_chars")), "pages": (table(spark, d, "pages"), "page_id", "html", F.length("html").cast("long"))},
        _Q
    )


@query(
    "expansions_shown",
    """SELECT lower(left(trim(p_name), 80)) AS label, count(*) AS n, max(p_partkey) AS code FROM part WHERE strip_accents(lower(p_name)) LIKE '%o%' GROUP BY 1 ORDER BY n DESC, label LIMIT 12"""
)
def expansions_shown(spark, d):
    return M.suggest_expansions(table(spark, d, "part").withColumn("p_name", F.col("p_name")), ["%o%"], "p_name", "p_partkey", shown=12)


@query(
    "history_by_year",
    f"SELECT year, count(*) AS n FROM (SELECT CAST(year(l_shipdate) AS INT) AS year FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_FOLD.format('p_name')} LIKE '%red%' UNION ALL SELECT CAST(year(o_orderdate) AS INT) FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_FOLD.format('c_mktsegment')} LIKE '%red%') WHERE year IS NOT NULL GROUP BY 1"
)
def history_by_year(spark, d):
    """Current and older tables together."""
    i = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return M.history_by_year({"current": (i, "p_name", F.year("l_shipdate")), "older": (o, "c_mktsegment", F.year("o_orderdate"))}, "RED")


@query("search_by_year", f"WITH {_RECORDS} SELECT CAST(year(closes) AS INT) AS year, count(*) AS n FROM records WHERE folded LIKE '%red%' AND folded LIKE '%widget%' GROUP BY 1")
def search_by_year(spark, d):
    return M.history_by_year({"current": (_records(spark, d), "text", F.year("closes"))}, "widget RED")


@query(
    "unit_price_semi",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 0 AND l_extendedprice / l_quantity BETWEEN 1000 AND 1010)"
)
def unit_price_semi(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return with_price_in(orders, _items(spark, d), "key", 1000, 1010).withColumnRenamed("key", "o_orderkey")


@query("unmatched_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unmatched_anti(spark, d):
    waiting = table(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return without_any(table(spark, d, "customer"), waiting, "c_custkey").select("c_custkey")


@query(
    "effective_terms",
    f"SELECT {_FOLD.format('p_name')} AS folded, len(list_filter(list_distinct([p_name, p_type, 'x']), lambda t: length(trim(t)) > 1)) AS terms, count(*) AS n FROM part GROUP BY 1, 2"
)
def effective(spark, d):
    p = table(spark, d, "part")
    return p.groupBy(
        fold_accents(F.col("p_name"), True).alias("folded"),
        F.size(effective_terms(F.array("p_name"), F.array(F.col("p_type"), F.lit("x")))).cast("long").alias("terms")
    ).agg(F.count("*").alias("n"))


@query(
    "due_monitors",
    f"WITH {_MONITORS} SELECT monitor_id, strftime(next_run, '%Y-%m-%d %H:%M:%S') AS next_run FROM monitors WHERE active AND next_run <= TIMESTAMP '2024-01-30' ORDER BY next_run, monitor_id LIMIT 25"
)
def due_monitors(spark, d):
    return M.due(_monitors(spark, d), datetime(2024, 1, 30)).select("monitor_id", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"))
