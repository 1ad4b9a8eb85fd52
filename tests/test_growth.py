"""What a query costs must grow no faster than its input: plans and shapes that decide it, on small tables."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tendril import catalog
from tendril.functions import parse as P
from tendril.operators import cubes as U
from tendril.operators import monitors as M
from tendril.operators import resolve as R
from tendril.operators import rule_index
from tendril.sources import delimited as D
from tendril.sources import payloads as N
from tendril.streaming.buckets import BucketTable


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_envelope_is_read_once(spark):
    """The agency and year of a plan are taken before its items are rows, not from the whole envelope for each item."""
    raw = spark.createDataFrame([('{"orgaoEntidadeCnpj": "1", "anoPca": 2024, "itens": [{"numeroItem": 1}, {"numeroItem": 2}]}',)], "payload string")
    items = N.normalize_plan_items(raw.where(F.col("payload") != ""))
    plan = _optimized(items.select("agency_id", "plan_year", "item"))
    assert plan.index("Generate explode") < plan.index("orgaoEntidadeCnpj")
    assert sorted((r.agency_id, r.plan_year, r.item) for r in items.collect()) == [("1", 2024, 1), ("1", 2024, 2)]


def test_halves_of_per_cents(spark):
    """Per cents that end in a half but for the last bit of a double are rounded as the SQL does, by the multiple."""
    rows = [(40.0, 207.54), (40.0, 229.82), (260.0, 426.27), (20.0, 348.39), (100.0, 99.95), (100.0, 100.0)]
    pct = P.pct_change(F.col("a"), F.col("b"))
    assert [r.p for r in spark.createDataFrame(rows, "a double, b double").select(pct.alias("p")).collect()] == [418.9, 474.6, 64.0, 1642.0, 0.0, 0.0]


def test_candidates_are_gathered_once_a_name_and_number(spark):
    """A hundred records that meet a hundred candidates: no join makes the pairs; a record that comes twice has all candidates once."""
    records = spark.range(100).selectExpr("concat('r', id) AS record_key", "'A' AS agency", "'7' AS number", "'C-X' AS city_uf")
    records = records.unionByName(spark.createDataFrame([("r5", "A", "8", "C-X"), ("r6", "A", "7", "C-X")], records.schema))
    candidates = spark.range(100).selectExpr("concat('c', id) AS canonical_key", "'a' AS agency", "'7' AS purchase_no", "CAST(NULL AS STRING) AS process_no")
    candidates = candidates.unionByName(spark.createDataFrame([("z", "a", "8", None)], "canonical_key string, agency string, purchase_no string, process_no string"))
    links, reviews = R.resolve_by_name_number(records, candidates, "s")
    assert links.count() == 0
    found = {r.record_key: r.candidates for r in R.queue_reviews(reviews.withColumn("resolved", F.lit(False)).limit(0), reviews.withColumn("resolved", F.lit(False)), ["record_key"], once=True).collect()}
    assert reviews.count() == 100 == len(found)
    assert len(found["r0"]) == 100 and found["r6"] == found["r0"] and found["r5"] == sorted([*found["r0"], "z"])


def test_lines_without_a_sort(spark, tmp_path):
    """Lines of two files are told without sorting either."""
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("id;x\n" + "".join(f'{i};"{i}\nb"\n' for i in range(5)), "utf-8")
    rows = D.numbered(D.read_delimited(spark, str(tmp_path), encoding="UTF-8"))
    assert "Window" not in _optimized(rows)
    assert sorted((r._file[-5:], r.id, r._line) for r in rows.collect()) == [(f"{k}.csv", str(i), i + 1) for k in range(2) for i in range(5)]


def test_a_baseline_reads_its_matches_once(spark):
    """What the matches are made of is worked out once, however many parts of the baseline ask for it."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    at = datetime(2024, 1, 1)
    rows = [(1, k, 10.0 + k, at, "x", None, "S", "A") for k in range(8)]
    schema = "monitor_id long, key long, value double, published timestamp, status string, status_source string, state string, agency string"
    matches = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    awards = spark.createDataFrame([(k, k % 3, 2.0) for k in range(8)], "key long, supplier long, unit_price double")
    out = M.baseline(matches, awards).collect()
    assert seen.value == 8 and (out[0].sample, out[0].median_value, out[0].prices, out[0].competition) == (8, 13.5, 8, 1.0)


def test_splits_do_not_multiply(spark, tmp_path):
    """A file of the test tables is cut into splits of 20 kB, a larger one into larger splits."""
    from tendril.queries.sources import _SPLITS, _split_size

    for n, size in ((60_000, 20 << 10), (64 << 20, (64 << 20) // _SPLITS)):
        with open(tmp_path / f"{n}.csv", "wb") as f:
            f.truncate(n)
        assert _split_size(spark, f"file://{tmp_path}/{n}.csv", "20k") == f"{size}b"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_a_tick_has_many_files(spark, monkeypatch):
    """A part of the records is one micro-batch, whatever the number of files that it comes in."""
    from tendril.queries import streams

    read, batches = [], []

    class Ticking:
        def __init__(self, folder, schema):
            self.folder = folder

        def tick(self, batch, n):
            batches.append(n)
            read.append(batch.select(F.input_file_name()).distinct().count())
            batch.selectExpr("key").write.parquet(f"{self.folder}/alerts-{n}")

    part = spark.range(100).withColumnRenamed("id", "key").repartition(4)
    assert streams._ticks(spark, "ticks", [part, part], Ticking).count() == 200
    assert batches == [0, 1] and read == [4, 4]


def test_many_rules_meet_words_not_texts(spark, monkeypatch):
    """Words of many rules are looked for in the distinct words of the texts; no text is searched once for each rule."""
    monkeypatch.setattr(rule_index, "FEW_GRAMS", 0)
    texts = [f"alpha{k % 3} beta{k % 2}x gamma\nde" for k in range(12)] + ["", None]
    rec = spark.createDataFrame([(k, t, *[None] * 6, 1.0, datetime(2024, 1, 1)) for k, t in enumerate(texts)],
        "key long, text string, state string, city string, agency string, modality string, status string, status_source string, value double, closes timestamp")
    base = {f.split()[0]: [] if "array" in f else None for f in M.RULE.split(", ")}
    given = {1: ["pha0 eta1"], 2: ["ALPHA1 mma"], 3: ["nothing", "x de"], 4: ["alpha2 alpha0"], 5: ["a%0 ma_d"]}
    rules = spark.createDataFrame([tuple((base | {"monitor_id": k, "include": v, "exclude": ["beta0"] if k == 2 else []}).values()) for k, v in given.items()], M.RULE)
    items = spark.createDataFrame([], "key long, unit_price double, code string")
    found = M.match_records(rec, items, rules, datetime(2024, 1, 1)).select("monitor_id", "key")
    plan = _optimized(found)
    assert plan.count("Contains(_token") == plan.count("Contains(") > 0
    want = {(1, k) for k in (3, 9)} | {(2, k) for k in (1, 7)} | {(3, k) for k in range(12)} | {(5, k) for k in range(12) if k % 3 == 0 or k % 2 == 0}  # words of one letter do not count
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_many_rules_meet_records_in_one_join(spark, monkeypatch):
    """Rules of words alone are met in one join and one reading of the texts, however many they are; those with other conditions are looked at again."""
    monkeypatch.setattr(rule_index, "FEW_GRAMS", 0)
    monkeypatch.setattr(rule_index, "RULES_AT_ONCE", 3)
    monkeypatch.setattr(rule_index, "BITS_AT_ONCE", 200, raising=False)
    texts = [f"Alpha{k % 3} béta{k % 2}x  gamma\tdelta{k % 5}" for k in range(20)] + ["", "alpha0", "alpha0"]
    rec = spark.createDataFrame([(k, t, *[None] * 6, float(k), datetime(2024, 1, 1)) for k, t in enumerate(texts)],
        "key long, text string, state string, city string, agency string, modality string, status string, status_source string, value double, closes timestamp")
    base = {f.split()[0]: [] if "array" in f else None for f in M.RULE.split(", ")}
    given = {k: {"include": [t]} for k, t in enumerate(["alpha0", "ALPHA1 eta1", "pha2 elta4", "gam%% bet%", "lta0 lta1", "amma amma", "a", "zz alpha0", "%% lph"])}
    given |= {20: {"include": ["alpha1 beta0 delta3", "elta2"]}, 21: {"include": ["gamma"], "exclude": ["alpha0 beta0", "lta1"]}, 30: {"include": ["alpha0"], "value_min": 9.0}}
    rules = spark.createDataFrame([tuple((base | {"monitor_id": k} | g).values()) for k, g in given.items()], M.RULE)
    items = spark.createDataFrame([], "key long, unit_price double, code string")

    def holds(text, terms):
        return any(all(w.strip("%") in text.lower().replace("é", "e") for w in t.lower().split()) for t in terms)

    def want(ids):
        return sorted((k, n) for k in ids for n, t in enumerate(texts) if (k == 6 or holds(t, given[k]["include"])) and not holds(t, given[k].get("exclude", [])) and n >= given[k].get("value_min", 0))

    found = M.match_records(rec, items, rules.where("monitor_id < 30 AND monitor_id <> 6"), datetime(2024, 1, 1)).select("monitor_id", "key")
    plan = _optimized(found)
    assert plan.count("ArrowEvalPython") == 1 == plan.count("NOT ((_bits") and plan.count("Join ") == 2  # the other one gives the rules' words their numbers
    assert sorted(map(tuple, found.collect())) == want(k for k in given if k < 30 and k != 6)
    every = M.match_records(rec, items, rules, datetime(2024, 1, 1)).select("monitor_id", "key")
    assert sorted(map(tuple, every.collect())) == want(given)  # of 6 no term is long enough, so it takes all


def test_feeds_read_a_payload_once(spark):
    """A payload of several feeds is read before it is a row of each, with what each feed makes of it alone."""
    raw = spark.createDataFrame([("c", '{"numero": "7", "emissao": "02/03/2024"}'), ("c", '{"id": "i1"}'), ("d", "{}")], "contract_id string, payload string")
    kinds = ("invoices", "guarantees")
    every = N.normalize_execution_feeds(raw, kinds)
    plan = _optimized(every)
    assert plan.index("Generate explode") < plan.index("get_json_object") and "Union" not in plan
    one = [N.normalize_execution(raw, k).select(*every.columns) for k in kinds]
    assert sorted(map(repr, every.collect())) == sorted(map(repr, one[0].unionByName(one[1]).collect()))
    assert len({(r.contract_id, r.kind, r.record_key) for r in every.collect()}) == 6


def test_a_bucket_of_many_rows_is_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """What a task merges and writes does not grow with the table, though its buckets stay as many; the session is left as it was."""
    monkeypatch.setattr(catalog, "ROWS_A_PART", 500)
    own, parts = spark.conf.get("spark.sql.shuffle.partitions"), []

    def put(old, new):
        out = old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))
        parts.append(out.rdd.getNumPartitions())
        return out

    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "k long, v long", 2)
    t.merge(spark.range(8000).selectExpr("id AS k", "1L AS v"), put)
    t.merge(spark.range(4000).selectExpr("id AS k", "2L AS v"), put)
    assert parts == [16, 24] and spark.conf.get("spark.sql.shuffle.partitions") == own
    assert max(r["count"] for r in t.read().groupBy(F.input_file_name()).count().collect()) < 2000
    assert sorted(map(tuple, t.read().groupBy("v").agg(F.count("*"), F.sum("k")).collect())) == [(1, 4000, sum(range(4000, 8000))), (2, 4000, sum(range(4000)))]


def test_deltas_of_a_cube_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """The cells that a batch changes are worked out once, by as many tasks as the rows ask for."""
    monkeypatch.setattr(catalog, "ROWS_A_PART", 50)
    parts = []
    monkeypatch.setattr(U, "stored", lambda df, name: (parts.append(df.rdd.getNumPartitions()), catalog.stored(df, name))[1])
    schema, by = "key long, seq long, day timestamp, price double", {"month": U.month_of("day")}
    cells = BucketTable(spark, f"file://{tmp_path}/c", ["month"], U.LiveCube.cells_schema({"month": "string"}, ["total"]), 2)
    cube = U.LiveCube(BucketTable(spark, f"file://{tmp_path}/r", ["key"], schema, 2), cells, by, {"total": F.col("price")}, "seq")
    rows = spark.range(400).selectExpr("id AS key", "1L AS seq", "timestamp '2024-01-05' + make_dt_interval(40 * (id % 2)) AS day", "1.0D AS price")
    cube.apply(rows, 1)
    cube.apply(rows.where("key < 100").withColumns({"seq": F.lit(2).cast("long"), "day": F.lit(datetime(2024, 3, 1)), "price": F.lit(2.0)}), 2)
    cube.apply(rows.where("key < 50"), 3)  # late: nothing changes
    assert parts == [8, 10, 9]
    assert sorted((r.month, r.n, float(r.total)) for r in cells.read().collect()) == [("2024-01", 150, 150.0), ("2024-02", 150, 150.0), ("2024-03", 100, 200.0)]


def test_winners_do_not_gather_by_monitor(spark):
    """Awards go once to the task of their tender; what most of the matches belong to, a monitor, is no key of a shuffle."""
    rules = spark.createDataFrame([(1, ["7"]), (2, [])], "monitor_id long, suppliers array<string>")
    matches = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 10)], "monitor_id long, key long")
    awards = spark.createDataFrame([(10, 1, 7, "b"), (10, 1, 7, "a"), (11, 2, None, "c"), (12, 1, 7, "d")], "key long, item int, supplier long, supplier_name string")
    found = M.award_alerts(matches, awards, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(monitor_id" not in plan and plan.count("Exchange hashpartitioning(key") == 2
    got = sorted((r.monitor_id, r.key, r.importance, '"a"' in r.details) for r in found.collect())
    assert got == [(1, "10:1:7", "alta", True), (1, "11:2:?", "media", False), (2, "10:1:7", "media", True)]
