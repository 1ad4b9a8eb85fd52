"""Keyed tables in buckets, fleets of monitors, the index of rules, quoted files in splits, quantiles, cubes, contents, versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tendril.functions.text import effective_terms, folded_matches, fold_accents
from tendril.operators import cubes as U
from tendril.operators import history as H
from tendril.operators import monitors as M
from tendril.operators import rule_index
from tendril.operators.quantiles import exact_quantiles
from tendril.sources import delimited as D
from tendril.sources import quoted as Q
from tendril.sources.content import ContentStore
from tendril.streaming.buckets import BucketTable
from tendril.streaming.fleet import Fleet, isolated

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def put(old, new):
    return old.unionByName(new).groupBy("k").agg(F.max("v").alias("v"))


def test_bucket_table_touches_what_it_must(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "k long, v long", 32)
    assert t.version() == 0 and t.read().count() == 0
    t.merge(spark.range(500).selectExpr("id AS k", "1L AS v"), put)
    before = t.manifest(1)
    batch = spark.createDataFrame([(3, 7), (None, 1), (9000, 2)], "k long, v long")
    touched = t.touched(batch)
    assert len(touched) <= 3
    assert {f.split("_bucket=")[1].split("/")[0] for f in t.read(touched).inputFiles()} <= {str(b) for b in touched}
    assert t.merge(batch, put) and t.version() == 2
    after = t.manifest(2)
    assert {b for b in after if after[b] == 2} == set(touched) and all(after[b] == before[b] for b in before if b not in touched)
    got = dict(map(tuple, t.read().collect()))
    assert len(got) == 502 and got[3] == 7 and got[None] == 1 and got[9000] == 2
    assert not t.merge(batch.withColumn("v", F.lit(99).cast("long")), put, version=2)  # there already
    assert dict(map(tuple, t.read().collect())) == got


def test_bucket_table_survives_a_run_that_ends_halfway(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", ["k"], "k long, v long", 8)
    t.merge(spark.range(40).selectExpr("id AS k", "1L AS v"), put)
    whole = rows(t.read())
    batch = spark.range(60).selectExpr("id AS k", "2L AS v")
    commit, t._commit = t._commit, lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.merge(batch, put)
    assert t.version() == 1 and rows(t.read()) == whole
    t._commit = commit
    assert t.merge(batch, put) and dict(map(tuple, t.read().collect())) == dict.fromkeys(range(60), 2)
    t.merge(batch.where("k < 3").withColumn("v", F.lit(3).cast("long")), put)
    t.merge(batch.where("k < 3").withColumn("v", F.lit(4).cast("long")), put)
    t.clean()
    assert t.version() == 4 and dict(map(tuple, t.read().collect()))[2] == 4 and t.read().count() == 60
    t.merge(batch.where("k = 5"), lambda old, new: old.where("k <> 5"))
    assert t.read().count() == 59


def _rules(spark, *given):
    base = {f.split()[0]: [] if "array" in f else None for f in M.RULE.split(", ")}
    return spark.createDataFrame([tuple((base | g).values()) for g in given], M.RULE)


def test_index_finds_what_the_loop_finds(spark, monkeypatch):
    """Rules of random words, with wildcards, short words and words of one letter, against a plain loop."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé%_ß\\") if rng.random() < 0.2 else rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5])))
    texts = [" ".join("".join(rng.choice("abcdeÉß\\%") for _ in range(rng.choice([2, 4, 9]))) for _ in range(rng.choice([0, 3, 12]))) for _ in range(60)] + [None, ""]
    rec = spark.createDataFrame(
        [(k, t, rng.choice(["SP", "RJ", None]), rng.choice(["A", "B", None]), str(k % 5)) for k, t in enumerate(texts)],
        "key long, text string, state string, agency string, supplier string"
    )
    given = [
        {
            "monitor_id": k, "include": [" ".join(word() for _ in range(rng.choice([1, 2]))) for _ in range(rng.choice([0, 1, 2]))],
            "exclude": [word()] if k % 9 == 0 else [], "states": ["SP"] if k % 4 == 0 else [], "agencies_in": ["A", "X"] if k % 5 == 0 else [],
            "suppliers": ["1", "3"] if k % 6 == 0 else []
        }
        for k in range(120)
    ]
    rules = _rules(spark, *given)
    live, ready = rec.withColumn("_folded", fold_accents(F.col("text"), True)), M._ready(rules)
    on = M._off_or("states", F.array_contains("states", F.col("state"))) & M._off_or("agencies_in", F.array_contains("agencies_in", F.col("agency")))
    terms = effective_terms(F.col("include"), F.col("approved"))
    holds = folded_matches(F.col("_folded"), terms)
    none_of = ~folded_matches(F.col("_folded"), F.col("exclude"))
    watched = F.coalesce(F.array_contains("suppliers", F.col("supplier")), F.lit(False))
    loop = live.crossJoin(rules)
    want = rows(loop.where(on & none_of & ((F.size(terms) == 0) | holds)).select("monitor_id", "key"))
    want_needed = rows(loop.where(on & none_of & (holds | watched)).select("monitor_id", "key"))
    for few, at_once in ((1000, 10_000), (0, 10_000), (0, 30)):
        monkeypatch.setattr(rule_index, "FEW_GRAMS", few)
        monkeypatch.setattr(rule_index, "RULES_AT_ONCE", at_once)
        found = rule_index.met(live, ready, on, state="state", agency="agency")
        assert rows(found.select("monitor_id", "key")) == want
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        needed = rule_index.met(live, ready, on, state="state", agency="agency", supplier="supplier", terms_needed=True)
        assert rows(needed.select("monitor_id", "key")) == want_needed
    counts = rule_index.letter_counts(live, "_folded")
    assert rows(rule_index.met(live, ready, on, state="state", agency="agency", counts=counts).select("monitor_id", "key")) == want


def test_failing_monitors_are_set_apart(spark):
    ran = []

    def run(ids):
        ran.append(ids)
        if {3, 7} & set(ids):
            spark.sql("SELECT raise_error('no ' || id) FROM range(1)").collect()

    got = isolated([1, 2, 3, 4, 5, 6, 7], run)
    assert {k for k, e in got.items() if e is None} == {1, 2, 4, 5, 6} and got[3] and got[7]
    assert len(ran) <= 12


def test_fleet(spark, tmp_path):
    """First run by monitor, turns, clocks, failure, both contract sources, and a tick that runs again."""
    rec = lambda *r: spark.createDataFrame(
        [(k, t, "SP", "c", "g", "m", "x", None, v, T0 + timedelta(days=9), None) for k, t, v in r],
        "key string, text string, state string, city string, agency string, modality string, status string, status_source string, value double, closes timestamp, awarded double"
    )
    contracts = spark.createDataFrame(
        [("1", "papel", "s", T0 + timedelta(days=5), "SP", 10.0)],
        "key string, text string, supplier string, ends timestamp, state string, value double"
    )
    gov = spark.createDataFrame([("1", "papel", "s", T0 + timedelta(days=50))], "key string, text string, supplier string, ends timestamp")
    tables = {"items": spark.createDataFrame([], "key string, unit_price double, code string"), "contracts": contracts, "contracts_gov": gov}
    rules = _rules(
        spark, {"monitor_id": 1, "include": ["papel"]}, {"monitor_id": 2, "include": ["papel"], "states": ["RJ"]},
        {"monitor_id": 3, "include": ["papel"], "cities": ["\\"]}, {"monitor_id": 4, "include": ["papel"]}
    )
    listed = lambda n: spark.createDataFrame(
        [(k, True, T0, 60 if k == 4 else 5) for k in ((1, 2, 3) if n == 0 else (1, 2, 3, 4))],
        "monitor_id long, active boolean, next_run timestamp, refresh_minutes int"
    )
    clock = lambda n: T0 + timedelta(minutes=10 * n)
    first = rec(("a", "papel", 1.0))
    fleet = Fleet(spark, f"file://{tmp_path}/f", first.schema, tables, lambda n: rules, listed, clock, buckets=4)
    alerts = lambda n: rows(spark.read.parquet(f"{tmp_path}/f/alerts-{n}").select("monitor_id", "key", "type"))
    fleet.tick(first, 0)
    assert alerts(0) == []  # all are new: silent
    fleet.tick(rec(("b", "papel", 2.0), ("a", "papel", 5.0)), 1)
    assert alerts(1) == [(1, "a", "PRICE_CHANGE"), (1, "b", "NEW_PROCUREMENT")]  # 4 is new and silent, 2 asks for another state
    fleet.tick(rec(("c", "papel", 2.0)), 2)
    assert alerts(2) == [(1, "c", "NEW_PROCUREMENT")]  # 4 is not due
    fleet.tick(rec(("c", "papel", 2.0)), 2)  # once more
    assert alerts(2) == [(1, "c", "NEW_PROCUREMENT")]
    state = {r.monitor_id: r for r in spark.read.parquet(f"{tmp_path}/f/fleet-2").collect()}
    assert state[3].next_run == clock(0) + timedelta(minutes=30) and state[3].seen is None  # it failed at the first tick and waits
    assert state[1].next_run == clock(2) + timedelta(minutes=5) and state[4].next_run == clock(1) + timedelta(minutes=60) and state[4].seen == 2
    memory = rows(fleet.memory.read().select("monitor_id", "entity", "key"))
    assert (1, "contract", "pncp:1") in memory and (1, "contract", "gov:1") in memory and (2, "contract", "gov:1") in memory and (2, "contract", "pncp:1") not in memory


def test_details_and_sources(spark):
    rules = _rules(spark, {"monitor_id": 1, "include": ["papel"]}).withColumn("first_run", F.lit(False))
    plans = spark.createDataFrame([("p", "papel " * 100, "g", 2025, 9.5)], "key string, text string, agency string, year int, value double")
    got = M.once_found({"plans": plans}, plans.select(F.lit(1).cast("long").alias("monitor_id"), "key"), rules, T0)["plan"].first()
    assert '"year":2025' in got.details and '"value":9.5' in got.details and len(got.details) < 300


@pytest.mark.parametrize("size", ["40b", "97b", "100k"])
def test_quoted_files_in_splits(spark, tmp_path, size):
    rng = random.Random(2)
    want, text = [], 'n;"a";b\n'
    at, line = len(text), 1
    for k in range(80):
        a = "".join(rng.choice(['x', ';', '""', "\n", "é"]) for _ in range(rng.choice([0, 2, 6, 60])))
        record = f'{k};"{a}";{"z" * (k % 5)}' + ("\r" if k % 9 == 0 else "")
        want.append((str(k), a.replace('""', '"') or None, "z" * (k % 5) or None, line + 1, at))
        text += record + "\n"
        at, line = len(text), line + record.count("\n") + 1
        if k == 40:
            text, at, line = text + "\n", at + 1, line + 1
    (tmp_path / "a.csv").write_bytes(text.encode("latin-1"))
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        df = Q.read_quoted(spark, str(tmp_path))
        got = sorted(map(tuple, df.select("n", "a", "b", "_line", "_offset").collect()), key=lambda r: int(r[0]))
        assert (Q.physical_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5) == (size != "100k")
        half = df.where("cast(n AS int) < 33")
        rest = Q.read_quoted(spark, str(tmp_path), after=Q.loaded(half))
        assert sorted(int(r.n) for r in rest.collect()) == list(range(33, 80))
        _, bad = D.quarantine(df, ["b"])
        assert {(r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()} == {("a.csv", w[3]) for w in want if not w[2]}
    finally:
        for n in names:
            spark.conf.unset(n)
    assert [(r[0], r[1] or None, r[2] or None, *r[3:]) for r in got] == want


def test_quantiles_of_any_group(spark):
    rng = random.Random(1)
    data = [
        (rng.choice(["a", "b", None]), rng.choice([None, 7.0, 7.0, rng.random() * 10 ** rng.randint(-3, 9)])) for _ in range(4000)
    ] + [("one", 3.0)] + [("same", 5.0)] * 400 + [("none", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(3)
    points = [0.0, 0.25, 0.5, 0.9, 1.0]
    want = df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, points))).alias("q"))
    for limit in (20, 10_000):
        assert rows(exact_quantiles(df, ["k"], "v", points, limit)) == rows(want)
    assert exact_quantiles(df.limit(0), ["k"], "v", points).count() == 0


def test_live_cube(spark, tmp_path):
    """Random changes in batches, each applied twice, against the cube of what is left."""
    rng = random.Random(3)
    schema = "key long, seq long, day timestamp, status string, price double"
    kept = {}
    by = {"month": U.month_of("day"), "status": F.col("status")}
    cube = U.LiveCube(
        BucketTable(spark, f"file://{tmp_path}/r", ["key"], schema, 4),
        BucketTable(spark, f"file://{tmp_path}/c", ["month"], U.LiveCube.cells_schema({"month": "string", "status": "string"}, ["total"]), 4), by,
        {"total": F.col("price")}, "seq"
    )
    for n in range(1, 4):
        batch = [(rng.randrange(30), rng.randrange(10), datetime(2024, rng.randint(1, 4), 5), rng.choice(["a", None]), float(rng.randrange(100))) for _ in range(40)]
        best = {}
        for r in batch:
            best.setdefault((r[0], r[1]), r)
        batch = list(best.values())
        df = spark.createDataFrame(batch, schema)
        cube.apply(df, n), cube.apply(df, n)
        for r in batch:
            old = kept.get(r[0])
            if old is None or (r[1], r[2], r[3] or "", r[4]) > (old[1], old[2], old[3] or "", old[4]):
                kept[r[0]] = r
    want = {}
    for r in kept.values():
        cell = want.setdefault((r[2].strftime("%Y-%m"), r[3]), [0, 0.0])
        cell[0], cell[1] = cell[0] + 1, cell[1] + r[4]
    assert rows(cube.cells.read().select("month", "status", "n", F.col("total").cast("double"))) == sorted(((*k, *v) for k, v in want.items()), key=repr)


def test_contents_once(spark, tmp_path):
    store = ContentStore(spark, f"file://{tmp_path}/s", 8)
    one = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "key string, content string")
    store.put(one, T0, 1), store.put(one, T0, 1)
    store.put(spark.createDataFrame([("a", "z"), ("e", "y")], "key string, content string"), T0, 2)
    assert sorted(bytes(r.content) for r in store.contents().collect()) == [b"x", b"y", b"z"]
    links = {r.key: r.sha256 for r in store.links.read().collect()}
    assert set(links) == {"a", "b", "c", "e"} and links["c"] == links["e"] and links["a"] != links["b"]


def test_as_of(spark):
    at = lambda d: T0 + timedelta(days=d)
    versions = spark.createDataFrame([(1, at(1), "v1"), (1, at(3), "v2"), (1, at(3), "v3"), (2, None, "w")], "k long, since timestamp, what string")
    moments = spark.createDataFrame(
        [(1, at(0), "before"), (1, at(1), "at"), (1, at(2), "between"), (1, at(9), "after"), (2, at(0), "null start"), (3, at(0), "unknown")],
        "k long, at timestamp, name string"
    )
    got = {r.name: r.what for r in H.as_of_join(moments, versions, ["k"], "at", "since").collect()}
    assert got == {"before": None, "at": "v1", "between": "v1", "after": "v3", "null start": "w", "unknown": None}
