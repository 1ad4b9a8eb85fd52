"""Merges, histories, monitors, resolution, quality: small tables and traps."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tendril.operators import history as H
from tendril.operators import monitors as M
from tendril.operators import rule_index
from tendril.operators import quality as Q
from tendril.operators import resolve as R

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def test_upsert_twice_is_once(spark):
    cur = spark.createDataFrame([(1, "a", 1.0, T0, T0), (2, "b", 2.0, T0, T0)], "k int, s string, v double, first_seen timestamp, last_seen timestamp")
    batch = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k int, s string, v double")
    policy = {"s": "coalesce_new", "v": "overwrite"}
    once = H.upsert(cur, batch, ["k"], T1, policy)
    assert rows(once, "k", "s", "v", "first_seen") == [(1, "a", 1.0, T0), (2, "b", 5.0, T0), (3, "c", None, T1)]
    assert rows(H.upsert(once, batch, ["k"], T1, policy)) == rows(once)
    assert H.classify(once, batch, ["k"], ["v"]).first().asDict() == {"inserted": 0, "updated": 0, "unchanged": 2}
    assert H.tracked_events(once, batch.select("k", "v"), ["k"], {"v": "VALOR_ALTERADO"}).count() == 0


def test_tracked_events(spark):
    cur = spark.createDataFrame([(1, 10.0), (2, None)], "k int, v double")
    batch = spark.createDataFrame([(1, 10.0), (2, 3.0), (9, 1.0)], "k int, v double")
    assert rows(H.tracked_events(cur, batch, ["k"], {"v": "VALOR_ALTERADO"})) == [(2, "VALOR_ALTERADO", "v", None, "3.0"), (9, "NOVO_REGISTRO", None, None, None)]


def sequential(state, batch):
    """One row after the other, as the rule is stated."""
    state = {k: (dict(d), v) for k, (d, v) in state.items()}
    events, versions = [], []
    for key, seq, doc in sorted(batch, key=lambda b: b[1]):
        if doc is None:
            continue
        if key not in state:
            state[key] = (dict(doc), 1)
            events.append((key, seq, "NOVO_REGISTRO", None, None))
            continue
        old, version = state[key]

        def same(a, b):
            try:
                return a == b or float(a) == float(b)
            except (TypeError, ValueError):
                return False

        changed = {f: v for f, v in doc.items() if f not in old or not same(old[f], v)}
        for f, v in changed.items():
            events.append((key, seq, f.upper() + "_ALTERADO", old.get(f), v))
        if changed:
            versions.append((key, seq, tuple(sorted(old.items())), version))
            version += 1
        state[key] = (old | doc, version)
    return events, state, versions


@pytest.mark.parametrize("seed", [1, 2])
def test_state_diff_like_one_after_the_other(spark, seed):
    r = random.Random(seed)
    doc = lambda: {f: r.choice(["a", "b", "1", "1.0", None]) for f in "xyz" if r.random() < 0.6}
    state = {k: (doc(), r.randrange(1, 5)) for k in range(0, 30, 2)}
    batch = [(r.randrange(30), seq, doc() if r.random() < 0.9 else None) for seq in range(300)]
    s = spark.createDataFrame([(k, d, v) for k, (d, v) in state.items()], "key int, data map<string,string>, version long")
    b = spark.createDataFrame(batch, "key int, seq long, data map<string,string>")
    events, after, closed = H.state_diff(s, b)
    want_events, want_state, want_versions = sequential(state, batch)
    assert sorted(map(repr, (tuple(e) for e in events.select("key", "seq", "type", "old_value", "new_value").collect()))) == sorted(map(repr, want_events))
    assert {e.key: (e.data, e.version) for e in after.collect()} == want_state
    assert sorted(repr((c.key, c.closed_by, tuple(sorted(c.data.items())), c.version)) for c in closed.collect()) == sorted(map(repr, want_versions))
    again, _, _ = H.state_diff(after, spark.createDataFrame([(k, 1000 + k, d) for k, (d, _) in want_state.items()], "key int, seq long, data map<string,string>"))
    assert again.count() == 0


def test_threshold_levels(spark):
    s = spark.createDataFrame([(1, k, p) for k, p in enumerate([50, 71, 75, 10, 72, 85, 95, 91, 70])], "k int, t int, pct int")
    assert [r.level for r in Q.threshold_alerts(s, ["k"], ["t"], "pct").orderBy("t").collect()] == [70, 80, 90, 70]


def test_resolution_ways(spark):
    records = spark.createDataFrame(
        [
            ("a", "Prefeitura de São João", "0012", "São João-SP"), ("b", "prefeitura DE SAO JOAO", "7", "São João-SP"), ("c", "", "5", "X-SP"),
            ("d", "Outra", "99", "Rio-RJ"), ("e", "Outra", "12a", "Rio-RJ"), ("f", "Prefeitura  de\tSão João", "1/2", None),
            ("g", "Outra", "5/2024", "-"), ("h", "Outra", "x", "Rio-RJ"), ("i", "Straße", "007", "Łódź-X-y")
        ],
        "record_key string, agency string, number string, city_uf string"
    )
    cands = spark.createDataFrame(
        [
            ("p1", "PREFEITURA DE SÃO JOÃO", "12", None), ("p2", "Prefeitura de Sao Joao", None, "00007/"),
            ("p3", "Prefeitura de Sao Joao", "7", "x"), ("p4", "STRASSE", "7a", "0-0-7")
        ],
        "canonical_key string, agency string, purchase_no string, process_no string"
    )
    links, review = R.resolve_by_name_number(records, cands, "s")
    assert rows(links) == [
        ("a", "p1", "linked"), ("c", "src:s:c", "source"), ("d", "proc:RJ:RIO:99", "new"), ("e", "proc:RJ:RIO:12", "new"), ("f", "p1", "linked"),
        ("g", "proc:XX:?:52024", "new"), ("h", "src:s:h", "source"), ("i", "p4", "linked")
    ]
    assert rows(review) == [("b", ["p2", "p3"])]
    none, _ = R.resolve_by_name_number(records, cands, "s", pending=records)
    assert none.count() == 0


def _rule(spark, **kw):
    base = {f.split()[0]: [] if "array" in f else None for f in M.RULE.split(", ")} | {"monitor_id": 1} | kw
    return spark.createDataFrame([tuple(base.values())], M.RULE)


def test_match_conditions(spark):
    rec = spark.createDataFrame(
        [
            ("a", "Compra de papel A4", "SP", "Campinas", None, "Pregão", "ABERTA", None, 10.0, T1),
            ("b", "papel e tinta", "RJ", "Rio", "X", "Pregão", None, "Encerrada", None, T1),
            ("c", None, "SP", "Santos", "Y", "OUTRA", None, None, 5.0, None)
        ],
        "key string, text string, state string, city string, agency string, modality string, status string, status_source string, value double, closes timestamp",
    )
    items = spark.createDataFrame([("a", 2.0, "77"), ("b", 9.0, "78")], "key string, unit_price double, code string")
    hit = lambda **kw: [r.key for r in M.match_records(rec, items, _rule(spark, **kw), T0).orderBy("key").collect()]
    assert hit(include=["papel"]) == ["a", "b"]
    assert hit(include=["papel"], exclude=["tinta"]) == ["a"]
    assert hit(include=["papel"], agencies_out=["X"]) == ["a"]  # a null agency passes
    assert hit(include=["papel"], value_min=1.0) == ["a"]  # a null value does not
    assert hit(include=["papel"], opens_within_days=1) == ["a", "b"]
    assert hit(include=["papel"], price_min=5.0) == ["b"] and hit(include=["papel"], codes=["77"]) == ["a"]
    assert hit(include=["papel"], cities=["CAMP"]) == [] and hit(include=["papel"], cities=["CAMP%"]) == ["a"]  # patterns as they are given
    assert hit() == ["a", "b", "c"] and hit(include=["a"]) == ["a", "b", "c"] and hit(states=["SP"]) == ["a", "c"]  # no terms: every record
    assert hit(include=["- -", "!?"]) == []
    assert hit(modalities=["preg%"]) == ["a", "b"] and hit(modalities=["PREG"]) == [] and hit(statuses=["encerr%", "x"]) == ["b"] and hit(statuses=["aberta"]) == ["a"] and hit(statuses=[""]) == ["c"]
    assert hit(include=["papel"], price_min=5.0, codes=["77"]) == [] and hit(codes=["78"], price_max=9.0) == ["b"]


def test_rules_in_parts(spark, monkeypatch):
    """The same alerts whatever the number of rules that are sent at once."""
    rec = spark.createDataFrame(
        [(f"k{k}", f"texto {k % 7} palavra", "SP", f"{k % 3}", k % 5 == 0, T1, str(k % 4)) for k in range(40)],
        "key string, text string, state string, agency string, cancelled boolean, ends timestamp, supplier string"
    )
    base = {f.split()[0]: [] if "array" in f else None for f in M.RULE.split(", ")}
    rules = spark.createDataFrame(
        [tuple((base | {"monitor_id": k, "include": [f"{k % 7} palavra"] if k % 2 else ["texto"], "agencies_in": [str(k % 3)]}).values()) for k in range(9)],
        M.RULE
    )
    ways = [lambda: M.register_alerts(rec, rules), lambda: M.plan_alerts(rec, rules), lambda: M.expiring_contract_alerts(rec, rules, T0)]
    whole = [rows(w()) for w in ways]
    monkeypatch.setattr(rule_index, "RULES_AT_ONCE", 2)
    assert all(whole) and [rows(w()) for w in ways] == whole


def test_raised_once(spark):
    memory = spark.createDataFrame([], M.MEMORY)
    found = spark.createDataFrame([(1, "a", "NEW_ATA"), (1, "a", "NEW_ATA"), (2, "a", "NEW_ATA")], "monitor_id long, key string, type string")
    memory, silent = M.raise_once(memory, found.where("monitor_id = 1"), "register", T0, first_run=True)
    assert silent.count() == 0 and memory.count() == 1
    memory, new = M.raise_once(memory, found, "register", T0)
    assert rows(new) == [(2, "a", "NEW_ATA")]
    assert M.raise_once(memory, found, "register", T1)[1].count() == 0
    assert M.raise_once(memory, found, "plan", T1)[1].count() == 2


def test_alerts_and_memory(spark):
    columns = "monitor_id long, key string, object string, value double, status string, status_source string, closes timestamp, state string, city string, agency string, modality string, awarded double"
    state = spark.createDataFrame([], columns.replace("key string,", "key string, first_seen timestamp, last_seen timestamp, last_checked timestamp,"))

    def found(*rows_):
        return spark.createDataFrame([(1, k, "o", v, s, src, c, "SP", "x", agency, "m", None) for k, s, src, v, c, agency in rows_], columns)

    rules = _rule(spark)
    first = found(("a", "ABERTA", None, 100.0, T1, "g"), ("b", None, "DESERTA", 2e6, None, "g"))
    after, alerts = M.remember(state, first, rules, T0, first_run=True)
    assert rows(alerts, "key", "type") == [("b", "DESERTED")]  # even on the silent run
    assert M.remember(state, first, _rule(spark, deserted=False), T0, first_run=True)[1].count() == 0
    again, quiet = M.remember(after, first, rules, T1)
    assert quiet.count() == 0 and {r.last_seen for r in again.collect()} == {T0} and {r.last_checked for r in again.collect()} == {T1}
    moved, quiet = M.remember(after, found(("a", "ABERTA", None, 100.0, T1, "other"), ("b", None, "DESERTA", 2e6, None, "g")), rules, T1)
    assert quiet.count() == 0 and {r.key: r.last_seen for r in moved.collect()} == {"a": T1, "b": T0}  # another agency: a change without an alert
    later, alerts = M.remember(again, found(("a", "ABERTA", None, 125.0, T1, "g"), ("c", "x", None, 2e6, None, "g")), rules, T1)
    assert rows(alerts, "key", "type", "importance", "new_text") == [("a", "PRICE_CHANGE", "alta", "R$ 125"), ("c", "NEW_PROCUREMENT", "alta", "R$ 2.000.000 em SP")]
    assert later.count() == 3  # what no longer matches is kept
    both = found(("d", "deserta e fracassada", None, None, None, "g"))
    assert rows(M.remember(again, both, rules, T1)[1], "type") == [("DESERTED",), ("NEW_PROCUREMENT",)]
    assert rows(M.remember(again, both, _rule(spark, deserted=False), T1)[1], "type", "new_text") == [
        ("FAILED", "deserta e fracassada"), ("NEW_PROCUREMENT", "valor não informado em SP")
    ]


def test_titles_of_alerts(spark):
    """By type; what is not known is called so or left out, whatever the details hold."""
    rows = [
        ("NEW_PROCUREMENT", '{"after":"R$ 1.234 em SP"}', "🚨 Nova oportunidade de R$ 1.234 encontrada em SP"),
        ("NEW_PROCUREMENT", '{"after":"valor não informado"}', "🚨 Nova oportunidade de valor não informado encontrada"),
        ("PRICE_CHANGE", '{"before":"R$ 1","after":"R$ 2","pct":100.0}', "💰 Valor estimado alterado em +100.0%"),
        ("PRICE_CHANGE", '{"before":"R$ 2","after":"R$ 1","pct":-50.0}', "💰 Valor estimado alterado em -50.0%"),
        ("PRICE_CHANGE", '{"after":"R$ 1"}', "💰 Valor estimado alterado"),
        ("PROCUREMENT_UPDATED", '{"before":"a","after":"b"}', "📌 Situação do processo atualizada: b"),
        ("PROCUREMENT_UPDATED", '{"before":"a","after":"a"}', "📌 Situação do processo atualizada"),
        ("NEW_WINNER", '{"supplier_name":"ACME"}', "🏆 ACME homologado em processo deste monitor"),
        ("NEW_WINNER", None, "🏆 Fornecedor homologado em processo deste monitor"),
        ("CONTRACT_EXPIRING", '{"value":1500000.4,"ends":"2000-01-31T00:00:00.000"}', "🔮 Contrato de R$ 1.500.000 vence em 30 dias"),
        ("CONTRACT_EXPIRING", "{}", "🔮 Contrato de valor n/i"),
        ("NEW_ATA", "{}", M.TITLES["NEW_ATA"]),
        ("OTHER", "{}", None),
        (None, "not JSON", None),
    ]
    df = spark.createDataFrame([(1, str(k), t, "media", d) for k, (t, d, _) in enumerate(rows)], "monitor_id long, key string, type string, importance string, details string")
    got = {int(r.key): r.title for r in M.titled(df, datetime(2000, 1, 1)).collect()}
    assert got == {k: title for k, (_, _, title) in enumerate(rows)}


def test_merged_table(spark, tmp_path):
    """Whole tables every few batches, old parts emptied, a batch that runs again changes nothing."""
    from tendril.streaming import core as S

    for how, want in ((S.add_counts(["k"]), lambda seen: {k: sum(k in b for b in seen) for b in seen for k in b}), (S.keep_latest(["k"], ["v"]), None)):
        kept, seen = S.MergedTable(str(tmp_path / str(want is None)), how, every=3), []
        for n in range(11):
            seen.append([n % 4, n % 3])
            batch = spark.createDataFrame([(k, n) for k in seen[-1]], "k int, v int")
            kept.put(batch, n)
            if n in (4, 8):
                kept.put(batch, n)
            got = {r.k: r[1] for r in kept.after(spark, n).collect()}
            if want is None:
                assert got == {k: max(m for m, b in enumerate(seen) if k in b) for b in seen for k in b}
            else:
                assert got == {k: sum(b.count(k) for b in seen) for b in seen for k in b}
    assert spark.read.parquet(str(tmp_path / "True" / "part-0")).count() == 0 and kept.after(spark, -1) is None


def test_sql_functions(spark):
    from tendril.functions.text import fold_accents, register_functions, text_matches

    register_functions(spark)
    df = spark.createDataFrame(
        [("Straße de PÃO", ["strasse pao", "x"]), ("a%b", ["%"]), ("œuvre", ["oeu_re"]), (None, ["a"]), ("back\\slash", ["k\\s"]), ("x", None)],
        "s string, terms array<string>"
    )
    got = df.selectExpr("fold_text(s) AS f", "text_ok(s, terms) AS ok", "effective_terms(terms, array('b', 'cc')) AS e").collect()
    want = df.select(fold_accents(F.col("s"), True).alias("f"), text_matches(F.col("s"), F.col("terms")).alias("ok")).collect()
    assert [(r.f, r.ok) for r in got] == [(r.f, r.ok) for r in want] and [r.ok for r in got] == [True, False, True, False, True, False]
    assert got[0].e == ["strasse pao", "cc"] and got[5].e == ["cc"]
