"""Saved-search monitors: rules against records, remembered matches, typed alerts, baselines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.catalog import checkpointed
from tendril.functions.parse import money_label, pct_change
from tendril.functions.text import effective_terms, fold_accents, text_matches, wildcard_words
from tendril.operators.market import last_n, money
from tendril.operators.quantiles import exact_quantiles
from tendril.operators.rule_index import met

#: Flags that are null are on; a null number of days is ``CONTRACT_DAYS``.
RULE = (
    "monitor_id long, include array<string>, exclude array<string>, approved array<string>, states array<string>, cities array<string>, agencies_in array<string>, agencies_out array<string>, "
    "modalities array<string>, statuses array<string>, value_min double, value_max double, opens_within_days int, price_min double, price_max double, codes array<string>, suppliers array<string>, "
    "deserted boolean, failed boolean, contracts boolean, contract_days int, registers boolean, plans boolean"
)
CONTRACT_DAYS, NEAR_DAYS = 180, 30
#: What is remembered of a match; a change of any of these is a change of the match.
SNAPSHOT = ("object", "value", "status", "status_source", "closes", "state", "city", "agency", "modality", "awarded")
OBJECT_CHARS, DETAIL_CHARS = 300, 200

def _listed(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _off_or(name: str, condition: Column) -> Column:
    """A condition by a list, which is off if the list is empty."""
    return (F.size(_listed(name)) == 0) | F.coalesce(condition, F.lit(False))


def _on(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(True))


def _any_like(name: str, value: Column) -> Column:
    """Whether some pattern of the list holds, as it is written, whatever the case."""
    return F.exists(name, lambda p: F.call_function("ilike", value, p))


def silent(rules: DataFrame, first_run: bool) -> Column:
    """Whether a rule's evaluation is its first, which is silent: by its own column ``first_run`` where there is one."""
    return F.coalesce(F.col("first_run"), F.lit(first_run)) if "first_run" in rules.columns else F.lit(first_run)


def _details(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """What is said of a record besides its key, as JSON: those of the columns that the table has."""
    shown = [(F.left("text", F.lit(DETAIL_CHARS)) if n == "text" else F.col(n)).alias("object" if n == "text" else n) for n in names if n in rows.columns]
    return F.to_json(F.struct(*shown)) if shown else F.lit("{}")


def _ready(rules: DataFrame) -> DataFrame:
    """Rules with their terms taken apart, once a rule."""
    terms = effective_terms(F.col("include"), F.col("approved"))
    return rules.withColumns({"_terms": F.size(terms), "_want": wildcard_words(terms), "_not": wildcard_words(_listed("exclude"))})


def ill_formed(rules: DataFrame) -> Column:
    """Whether a rule has a pattern that LIKE refuses: a backslash that stands before anything but ``%``, ``_`` or itself."""
    bad = lambda p: p.rlike(r"^(?:[^\\]|\\[%_\\])*\\(?:$|[^%_\\])")
    return reduce(lambda a, b: a | b, [F.exists(_listed(c), bad) for c in ("cities", "modalities", "statuses")])


def match_records(records: DataFrame, items: DataFrame, rules: DataFrame, as_of, counts: DataFrame | None = None) -> DataFrame:
    """``monitor_id`` with the columns of each record that meets all of a rule's conditions.

    ``records``: ``key, text, state, city, agency, modality, status, status_source,
    value, closes``; ``items``: ``key, unit_price, code``.  Empty lists and null
    bounds are conditions that are off; a rule without terms takes every record that
    meets the others.  Cities, modalities and statuses are patterns of LIKE, whatever
    the case; the status is that of the record, else that of its source, else empty.
    A null agency passes ``agencies_out``; a null value fails both bounds.  Texts
    are folded once a record, or before where there is a column ``_folded``, and rules once a rule.  Records meet the rules by the
    index of :mod:`tendril.operators.rule_index`, for which ``counts`` may say how
    frequent letters are; hits of rules that ask for items are kept by semi-joins with
    those items that some rule asks for.
    """
    ready = _ready(rules).withColumns({"_priced": F.col("price_min").isNotNull() | F.col("price_max").isNotNull(), "_coded": F.size(_listed("codes")) > 0})
    plain = F.octet_length("text") == F.length("text")  # of one byte each: there is nothing to fold but capitals
    fold = None if "_folded" in records.columns else F.when(plain, F.lower("text")).otherwise(fold_accents(F.col("text"), True))
    status = F.coalesce("status", "status_source", F.lit(""))
    within = F.col("closes").between(F.lit(as_of), F.lit(as_of) + F.make_dt_interval(F.col("opens_within_days")))
    on = (
        (F.col("value_min").isNull() | F.coalesce(F.col("value") >= F.col("value_min"), F.lit(False)))
        & (F.col("value_max").isNull() | F.coalesce(F.col("value") <= F.col("value_max"), F.lit(False)))
        & (F.col("opens_within_days").isNull() | F.coalesce(within, F.lit(False)))
        & _off_or("states", F.array_contains("states", F.col("state")))
        & _off_or("agencies_in", F.array_contains("agencies_in", F.col("agency")))
        & (F.col("agency").isNull() | (F.size(_listed("agencies_out")) == 0) | ~F.array_contains("agencies_out", F.col("agency")))
        & _off_or("cities", _any_like("cities", F.col("city")))
        & _off_or("modalities", _any_like("modalities", F.col("modality")))
        & _off_or("statuses", _any_like("statuses", status))
    )
    listed = ("states", "agencies_in", "agencies_out", "cities", "modalities", "statuses")
    free = reduce(lambda a, b: a & b, [F.size(_listed(c)) == 0 for c in listed] + [F.col(c).isNull() for c in ("value_min", "value_max", "opens_within_days")])
    kept = ["monitor_id", *[c for c in records.columns if c != "_folded"]]
    unit = items.select(F.col("key").alias("_key"), "unit_price", F.col("code").cast("string").alias("_code"))
    fits = (F.col("price_min").isNull() | (F.col("unit_price") >= F.col("price_min"))) & (F.col("price_max").isNull() | (F.col("unit_price") <= F.col("price_max")))
    own, found = F.col("key") == F.col("_key"), []
    for of_prices, of_codes in sorted(map(tuple, ready.select("_priced", "_coded").distinct().collect())):  # four at most
        some = ready.where((F.col("_priced") == of_prices) & (F.col("_coded") == of_codes))
        hits = met(records, some, on, state="state", agency="agency", counts=counts, fold=fold, free=None if of_prices or of_codes else free)
        if of_prices:
            hits = hits.join(unit.where(_widest(some)), own & fits, "left_semi")
        if of_codes:
            codes = some.select(F.explode("codes").alias("_code")).distinct()
            hits = hits.join(unit.join(codes, "_code", "left_semi"), own & F.array_contains("codes", F.col("_code")), "left_semi")
        found.append(hits.select(*kept))
    return reduce(DataFrame.unionByName, found) if found else met(records, ready, on, state="state", agency="agency", counts=counts, fold=fold).select(*kept)


def _widest(rules: DataFrame) -> Column:
    """Whether ``unit_price`` is within the widest bounds of the rules, each of which has some: items beyond them meet no rule."""
    bounds = rules.agg(F.min("price_min").alias("low"), F.max("price_max").alias("high"), *[F.bool_or(F.col(c).isNull()).alias(c) for c in ("price_min", "price_max")]).first()
    above = F.lit(True) if bounds.price_min else F.col("unit_price") >= bounds.low
    return above if bounds.price_max else above & (F.col("unit_price") <= bounds.high)


def snapshot(records: DataFrame) -> DataFrame:
    """Matched records as they are remembered: ``monitor_id, key`` and ``SNAPSHOT``; ``awarded`` is null where it is not known."""
    known = records if "awarded" in records.columns else records.withColumn("awarded", F.lit(None).cast("double"))
    return known.select("monitor_id", "key", F.left("text", F.lit(OBJECT_CHARS)).alias("object"), *SNAPSHOT[1:])


def remember(state: DataFrame, matches: DataFrame, rules: DataFrame, as_of, first_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """The match table after an evaluation, and the alerts that it raises.

    ``state``: ``monitor_id, key, first_seen, last_seen, last_checked`` and the
    snapshot columns; ``matches``: ``monitor_id, key`` and the snapshot columns;
    ``rules`` say whether deserted and failed tenders are watched.  A match is never
    retired; ``last_seen`` moves only when its snapshot changes.  On a silent first
    run new tenders raise nothing, but deserted and failed ones still do; it is that of
    each rule whose column ``first_run`` says so, or of all rules by the argument.
    """
    now = F.lit(as_of)
    old = state.select("monitor_id", "key", "first_seen", "last_seen", "last_checked", *[F.col(c).alias(f"old_{c}") for c in SNAPSHOT], F.lit(True).alias("known"))
    both = old.join(matches.select("monitor_id", "key", *SNAPSHOT, F.lit(True).alias("seen")), ["monitor_id", "key"], "full")
    both = both.join(
        rules.select("monitor_id", _on("deserted").alias("_deserted"), _on("failed").alias("_failed"), silent(rules, first_run).alias("_silent")),
        "monitor_id", "left"
    )
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in SNAPSHOT])
    both = both.withColumn("is_new", F.col("known").isNull()).withColumn("changed", F.col("known").isNotNull() & F.col("seen").isNotNull() & changed)
    kept = lambda c: F.when(F.col("seen").isNull(), F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    last_seen = F.when(F.col("is_new") | F.col("changed"), now).otherwise(F.col("last_seen"))
    last_checked = F.when(F.col("seen").isNotNull(), now).otherwise(F.col("last_checked"))
    after = both.select(
        "monitor_id", "key", F.coalesce("first_seen", now).alias("first_seen"), last_seen.alias("last_seen"), last_checked.alias("last_checked"),
        *map(kept, SNAPSHOT)
    )

    soon = F.coalesce(F.col("closes") < now + F.expr("interval 48 hours"), F.lit(False))
    status = F.lower(F.coalesce("status", "status_source", F.lit("")))
    deserted = F.coalesce(F.col("_deserted"), F.lit(True)) & status.like("%desert%")
    failed = ~deserted & F.coalesce(F.col("_failed"), F.lit(True)) & status.like("%fracass%")
    pct = pct_change(F.col("old_value"), F.col("value"))
    differ = lambda c: F.col("changed") & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")

    def alert(on: Column, kind: str, importance: Column, old_text: Column, new_text: Column, pct: Column = F.lit(None).cast("double")) -> Column:
        return F.when(on, F.struct(F.lit(kind).alias("type"), importance.alias("importance"), old_text.alias("old_text"), new_text.alias("new_text"), pct.alias("pct")))

    offered = F.concat(money_label(F.col("value")), F.coalesce(F.concat(F.lit(" em "), F.col("state")), F.lit("")))
    alerts = F.array(
        alert(
            F.col("is_new") & ~F.coalesce("_silent", F.lit(first_run)), "NEW_PROCUREMENT",
            F.when(soon, "critica").when(F.coalesce(F.col("value") >= 1_000_000, F.lit(False)), "alta").otherwise("media"), none, offered
        ),
        alert(F.col("is_new") & deserted, "DESERTED", F.lit("media"), none, status),
        alert(F.col("is_new") & failed, "FAILED", F.lit("media"), none, status),
        alert(
            differ("value"), "PRICE_CHANGE", F.when(F.coalesce(F.abs(pct) >= 20, F.lit(False)), "alta").otherwise("media"),
            money_label(F.col("old_value")), money_label(F.col("value")), pct
        ),
        alert(differ("closes"), "DEADLINE_CHANGED", F.when(soon, "critica").otherwise("alta"), F.date_format("old_closes", "yyyy-MM-dd"), F.date_format("closes", "yyyy-MM-dd")),
        alert(differ("status") | differ("awarded"), "PROCUREMENT_UPDATED", F.lit("media"), text("old_status"), text("status")),
    )
    raised = both.select("monitor_id", "key", F.explode(F.filter(alerts, lambda a: a.isNotNull())).alias("a")).select("monitor_id", "key", "a.*")
    return after, raised


MEMORY = "monitor_id long, entity string, key string, first_seen timestamp"


def raise_once(memory: DataFrame, found: DataFrame, entity: str, as_of, first_run: bool = False, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The memory after an evaluation, and the alerts of ``found`` that it did not hold: each is raised once, never again.

    ``memory`` has the columns of ``MEMORY``; ``found``: ``monitor_id, key`` and what
    the alert says.  A first run is silent, but what it finds is remembered; it is that
    of each of ``rules`` whose column ``first_run`` says so, or of all by the argument.
    """
    known = memory.where(F.col("entity") == entity).select("monitor_id", "key")
    new = found.dropDuplicates(["monitor_id", "key"]).join(known, ["monitor_id", "key"], "left_anti")
    after = memory.unionByName(
        new.select("monitor_id", F.lit(entity).alias("entity"), F.col("key").cast("string").alias("key"), F.lit(as_of).cast("timestamp").alias("first_seen"))
    )
    if rules is None or "first_run" not in rules.columns:
        return after, new.limit(0) if first_run else new
    quiet = rules.where(silent(rules, first_run)).select("monitor_id")
    return after, new.join(quiet, "monitor_id", "left_anti")


def award_alerts(matches: DataFrame, awards: DataFrame, rules: DataFrame) -> DataFrame:
    """``monitor_id, key`` (tender:item:supplier) of winners on matched tenders, high if the rule watches the supplier.

    A winner without a number is ``?``.  ``details`` has what the awards say of the
    supplier's name, prices and process.  Awards are shuffled once, by tender, and then
    grouped; rules are broadcast, as few monitors may have most of the matches.
    """
    told = _details(awards.withColumn("process", F.col("key")), ("supplier_name", "supplier", "unit_price", "award_value", "process"))
    keyed = awards.withColumn("process", F.col("key")).select("key", "item", F.col("supplier").cast("string").alias("supplier"), told.alias("details"))
    keyed = keyed.repartition("key").groupBy("key", "item", "supplier").agg(F.min("details").alias("details"))
    won = matches.select("monitor_id", "key").join(keyed, "key").withColumn("key", F.concat_ws(":", "key", "item", F.coalesce("supplier", F.lit("?"))))
    watched = F.coalesce(F.array_contains("suppliers", F.col("supplier")), F.lit(False))
    return won.join(F.broadcast(rules.select("monitor_id", "suppliers")), "monitor_id").select(
        "monitor_id", "key", F.lit("NEW_WINNER").alias("type"), F.when(watched, "alta").otherwise("media").alias("importance"), "details"
    )


def expiring_contract_alerts(contracts: DataFrame, rules: DataFrame, as_of, states: bool = True) -> DataFrame:
    """Contracts that end within a rule's days, by term or watched supplier and not excluded; high if within ``NEAR_DAYS``.

    ``contracts``: ``key, text, supplier, ends, state``; ``states`` is off for a
    source that does not tell them.  Only contracts in the longest range of days meet
    the rules.
    """
    day = F.to_date(F.lit(as_of))
    asked = F.coalesce("contract_days", F.lit(CONTRACT_DAYS))
    longest = rules.agg(F.max(asked)).first()[0] or 0
    soon = contracts.where(F.to_date("ends").between(day, F.date_add(day, longest))).withColumns(
        {"_folded": fold_accents(F.col("text"), True), "days_left": F.datediff(F.col("ends"), day)}
    )
    on = _on("contracts") & (F.col("days_left") <= asked) & (_off_or("states", F.array_contains("states", F.col("state"))) if states else F.lit(True))
    found = met(soon, _ready(rules), on, state="state" if states else None, supplier="supplier", terms_needed=True)
    importance = F.when(F.col("days_left") <= NEAR_DAYS, "alta").otherwise("media")
    details = _details(contracts, ("text", "value", "ends", "supplier_name", "state") if states else ("text", "value", "ends", "supplier_name"))
    return found.select("monitor_id", "key", F.lit("CONTRACT_EXPIRING").alias("type"), "days_left", importance.alias("importance"), details.alias("details"))


#: The sources of contracts: the mark before their keys, and whether they tell the state.
CONTRACT_SOURCES = {"contracts": ("pncp:", True), "contracts_gov": ("gov:", False)}


def contract_alerts(tables: dict[str, DataFrame], rules: DataFrame, as_of) -> DataFrame:
    """Expiring contracts of all sources that ``tables`` has, with the source's mark before the key."""
    found = [
        expiring_contract_alerts(tables[n].withColumn("key", F.concat(F.lit(mark), F.col("key").cast("string"))), rules, as_of, states) for n,
        (mark, states) in CONTRACT_SOURCES.items() if n in tables
    ]
    return reduce(DataFrame.unionByName, found)


def _of_terms(records: DataFrame, rules: DataFrame, on: Column, kind: str, **lists) -> DataFrame:
    live = records.withColumn("_folded", fold_accents(F.col("text"), True))
    found = met(live, _ready(rules), on, terms_needed=True, **lists)
    details = _details(records, ("text", "value", "ends", "year", "wanted", "state", "agency"))
    return found.select("monitor_id", "key", F.lit(kind).alias("type"), F.lit("media").alias("importance"), details.alias("details"))


def register_alerts(registers: DataFrame, rules: DataFrame) -> DataFrame:
    """Price registers (``key, text, state, cancelled``) of the rules' terms and states, whatever the agency; none that is cancelled."""
    live = registers.where(~F.coalesce("cancelled", F.lit(False)))
    return _of_terms(live, rules, _on("registers") & _off_or("states", F.array_contains("states", F.col("state"))), "NEW_ATA", state="state")


def plan_alerts(plans: DataFrame, rules: DataFrame) -> DataFrame:
    """Plan items (``key, text, agency``) of the rules' terms and agencies, whatever the state."""
    return _of_terms(plans, rules, _on("plans") & _off_or("agencies_in", F.array_contains("agencies_in", F.col("agency"))), "NEW_PCA", agency="agency")


def evaluate(state: DataFrame, memory: DataFrame, tables: dict[str, DataFrame], rules: DataFrame, as_of, first_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One evaluation of all ``rules`` at once: (match table, memory, alerts).

    ``tables``: ``records`` and ``items``, and where there are any ``awards``,
    ``contracts``, ``contracts_gov``, ``registers`` and ``plans``, as the operators above
    take them.  Alerts are ``monitor_id, key, type, importance, details``.
    """
    matches = snapshot(match_records(tables["records"], tables["items"], rules, as_of))
    state, alerts = remember(state, matches, rules, as_of, first_run)
    alerts = told(alerts)
    for entity, found in once_found(tables, state, rules, as_of).items():
        memory, new = raise_once(memory, found, entity, as_of, first_run, rules)
        alerts = alerts.unionByName(new.select(*ALERT))
    return state, memory, alerts


ALERT = ("monitor_id", "key", "type", "importance", "details")


def told(alerts: DataFrame) -> DataFrame:
    """Alerts of changed matches in the columns that all alerts have."""
    return alerts.select(
        "monitor_id", F.col("key").cast("string").alias("key"), "type", "importance",
        F.to_json(F.struct(F.col("old_text").alias("before"), F.col("new_text").alias("after"), "pct")).alias("details")
    )


#: What alerts are called, by type.
TITLES = {
    "NEW_PROCUREMENT": "🚨 Nova oportunidade de ",
    "DESERTED": "💎 Processo deserto identificado — possível recompra à frente",
    "FAILED": "💎 Processo fracassado identificado — possível republicação",
    "PRICE_CHANGE": "💰 Valor estimado alterado",
    "DEADLINE_CHANGED": "⏰ Prazo de propostas alterado",
    "PROCUREMENT_UPDATED": "📌 Situação do processo atualizada",
    "NEW_WINNER": "🏆 ",
    "CONTRACT_EXPIRING": "🔮 Contrato de ",
    "NEW_ATA": "📜 Nova ata de registro de preços no seu mercado",
    "NEW_PCA": "📅 Item de plano de contratações (PCA) relacionado ao seu monitor — compra futura sinalizada",
}


def titled(alerts: DataFrame, as_of) -> DataFrame:
    """Alerts in the columns of ``ALERT`` with a ``title``, a line for people made of the type and the details.

    A tender's title tells its value and state, a change of price its per cent, a
    winner's its name, a contract's its value and the days that are left; what is not
    known is left out or called so.  A type without a title has a null one.  ``details``
    are read once a row; no other column is needed.
    """
    said = F.from_json("details", "before string, after string, pct double, value double, ends string, supplier_name string")
    at = F.col("_said")
    optional = lambda c: F.coalesce(c, F.lit(""))
    pct = at["pct"].cast("decimal(28,1)")
    worth = F.when(at["value"].isNull(), "valor n/i").otherwise(money_label(at["value"]))
    days = F.datediff(F.to_date(F.left(at["ends"], F.lit(10))), F.to_date(F.lit(as_of)))
    more = {
        # the label of a value has no " em " of its own
        "NEW_PROCUREMENT": F.regexp_replace(at["after"], r"^(.*?)( em .*)?$", "$1 encontrada$2"),
        "PRICE_CHANGE": optional(F.concat(F.lit(" em "), F.when(pct > 0, "+").otherwise(""), pct.cast("string"), F.lit("%"))),
        "PROCUREMENT_UPDATED": optional(F.concat(F.lit(": "), F.when(~at["after"].eqNullSafe(at["before"]), at["after"]))),
        "NEW_WINNER": F.concat(F.coalesce(at["supplier_name"], F.lit("Fornecedor")), F.lit(" homologado em processo deste monitor")),
        "CONTRACT_EXPIRING": F.concat(worth, optional(F.concat(F.lit(" vence em "), days.cast("string"), F.lit(" dias")))),
    }
    title = F.coalesce(*[F.when(F.col("type") == k, F.concat(F.lit(begins), more.get(k, F.lit("")))) for k, begins in TITLES.items()])
    return alerts.withColumn("_said", said).withColumn("title", title).drop("_said")


def once_found(tables: dict[str, DataFrame], matches: DataFrame, rules: DataFrame, as_of) -> dict[str, DataFrame]:
    """By entity what the rules find in the other tables that there are, in the columns of ``ALERT``."""
    kinds = {
        "award": ("awards" in tables, lambda: award_alerts(matches, tables["awards"], rules)), "contract": (
            any(n in tables for n in CONTRACT_SOURCES), lambda: contract_alerts(tables, rules, as_of)
        ),
        "register": ("registers" in tables, lambda: register_alerts(tables["registers"], rules)), "plan": ("plans" in tables, lambda: plan_alerts(tables["plans"], rules)),
    }
    return {entity: found().withColumn("key", F.col("key").cast("string")).select(*ALERT) for entity, (there, found) in kinds.items() if there}


def price_quartiles(matches: DataFrame, awards: DataFrame) -> DataFrame:
    """Quartiles and number of the positive awarded unit prices (``unit_price``) on each monitor's tenders."""
    prices = matches.select("monitor_id", "key").join(awards.where(F.col("unit_price") > 0).select("key", "unit_price"), "key")
    counts = prices.groupBy("monitor_id").agg(F.count("*").alias("prices"))
    return counts.join(exact_quantiles(prices, ["monitor_id"], "unit_price", [0.25, 0.5, 0.75]), "monitor_id").select(
        "monitor_id", "prices", *[F.round(F.col("q")[k], 4).alias(n) for k, n in enumerate(("p25", "median_price", "p75"))]
    )


def _counted(matches: DataFrame, by: Column, name: str) -> DataFrame:
    """The matches' counts by ``by`` as one map for each monitor; nulls do not count."""
    n = matches.select("monitor_id", by.alias("_by")).where(F.col("_by").isNotNull()).groupBy("monitor_id", "_by").agg(F.count("*").alias("n"))
    return n.groupBy("monitor_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_by", "n")))).alias(name))


#: What a baseline says of itself.
METHOD = "Counted from records that were collected; the period is that of the tables."


def baseline(matches: DataFrame, awards: DataFrame) -> DataFrame:
    """A row per monitor about its matched tenders.

    Sample, period, value, median of positive values, deserted and failed tenders,
    mean number of distinct suppliers over tenders that have awards (null ones do not
    count), quartiles of awarded unit prices, tenders by month and by state, the ten
    agencies with most tenders, and how it was made.  The matches are written to the
    checkpoint folder first, as every one of these reads them.
    """
    matches = checkpointed(matches.select("monitor_id", "key", "value", "published", "status", "status_source", "state", "agency"))
    status = F.lower(F.coalesce("status", "status_source", F.lit("")))
    m = matches.groupBy("monitor_id").agg(
        F.count("*").alias("sample"), F.date_format(F.min("published"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("published"), "yyyy-MM-dd").alias("last"), money("value").alias("total_value"),
        F.count_if(status.like("%desert%")).alias("deserted"), F.count_if(status.like("%fracass%")).alias("failed"),
    )
    medians = exact_quantiles(matches.where(F.col("value") > 0), ["monitor_id"], "value", [0.5]).select("monitor_id", F.col("q")[0].alias("median_value"))
    m = m.join(medians, "monitor_id", "left")
    per = matches.select("monitor_id", "key").join(awards.select("key", "supplier"), "key").groupBy("monitor_id", "key").agg(F.countDistinct("supplier").alias("n")).groupBy("monitor_id").agg(
        F.round(F.avg("n"), 4).alias("competition")
    )
    agencies = matches.where(F.col("agency").isNotNull()).groupBy("monitor_id", "agency").agg(F.count("*").alias("n"))
    agencies = last_n(agencies, ["monitor_id"], [F.desc("n"), F.col("agency")], 10).groupBy("monitor_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("agency", "n")))).alias("agencies")
    )
    out = m.join(per, "monitor_id", "left")
    for part in (price_quartiles(matches, awards), _counted(matches, F.date_format("published", "yyyy-MM"), "by_month"), _counted(matches, F.col("state"), "by_state"), agencies):
        out = out.join(part, "monitor_id", "left")
    return out.withColumn("method", F.lit(METHOD))


def competitors(matches: DataFrame, awards: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` suppliers with most awarded value on each monitor's tenders."""
    sums = matches.select("monitor_id", "key").join(awards, "key").groupBy("monitor_id", "supplier").agg(F.count("*").alias("awards"), money("award_value").alias("total_value"))
    w = Window.partitionBy("monitor_id").orderBy(F.col("total_value").desc_nulls_last(), "supplier")
    return sums.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def cards(matches: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Counts for each monitor: matches, open ones, alerts, those of the last 24 hours, and high ones that are not read.

    ``alerts``: ``monitor_id, importance, raised_at, read``.
    """
    m = matches.groupBy("monitor_id").agg(F.count("*").alias("matches"), F.count_if(F.col("closes") > F.lit(as_of)).alias("open"))
    fresh = F.col("raised_at") > F.lit(as_of) - F.expr("interval 24 hours")
    unread = F.col("importance").isin("alta", "critica") & ~F.coalesce("read", F.lit(False))
    a = alerts.groupBy("monitor_id").agg(F.count("*").alias("alerts"), F.count_if(fresh).alias("last_day"), F.count_if(unread).alias("unread_high"))
    return m.join(a, "monitor_id", "left").fillna(0, ["alerts", "last_day", "unread_high"])


def fleet_stats(monitors: DataFrame, matches: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """One row about all monitors: how many, active, matches, alerts, those of the last 24 hours, and the next run."""
    fresh = F.col("raised_at") > F.lit(as_of) - F.expr("interval 24 hours")
    one = monitors.agg(F.count("*").alias("monitors"), F.count_if("active").alias("active"), F.min(F.when(F.col("active"), F.col("next_run"))).alias("next_run"))
    return one.crossJoin(matches.agg(F.count("*").alias("matches"))).crossJoin(alerts.agg(F.count("*").alias("alerts"), F.count_if(fresh).alias("last_day")))  # single rows


def reschedule(monitors: DataFrame, evaluated: DataFrame, as_of) -> DataFrame:
    """Monitors after a tick: those in ``evaluated`` (``monitor_id, ok``) run again after their minutes, or 30 where they failed."""
    done = monitors.join(evaluated.select("monitor_id", "ok"), "monitor_id", "left")
    wait = F.when(F.col("ok"), F.col("refresh_minutes")).otherwise(F.lit(30))
    after = F.lit(as_of) + F.make_dt_interval(mins=wait)
    return done.select(*[F.when(F.col("ok").isNotNull(), after).otherwise(F.col(c)).alias(c) if c == "next_run" else F.col(c) for c in monitors.columns])


def new_since(alerts: DataFrame, ident: str, last) -> DataFrame:
    """Alerts with an id above the last one that was seen."""
    return alerts.where(F.col(ident) > F.lit(last))


def suggest_expansions(items: DataFrame, terms: list[str], text: str, code: str, n: int = 20, shown: int | None = None) -> DataFrame:
    """The ``n`` most frequent descriptions (lower case, 80 characters) that the terms match, with a code of each; the first ``shown`` of them."""
    from tendril.functions.text import label80

    hit = items.where(text_matches(F.col(text), F.array(*map(F.lit, terms))))
    top = hit.groupBy(label80(F.col(text)).alias("label")).agg(F.count("*").alias("n"), F.max(code).alias("code")).orderBy(F.desc("n"), "label").limit(n)
    return top if shown is None else top.orderBy(F.desc("n"), "label").limit(shown)


def search(tables: dict[str, tuple[DataFrame, str, str, Column]], q: str, limit: int = 20, most: int = 50) -> DataFrame:
    """Rows of several tables that hold all words of ``q``, newest first in each, at most ``limit`` (capped at ``most``).

    ``tables``: name to (df, key, text, order value).
    """
    n = min(limit, most)
    rows = []
    for name, (df, key, text, rank) in tables.items():
        hit = df.where(text_matches(F.col(text), F.array(F.lit(q)))).select(F.lit(name).alias("origin"), F.col(key).alias("key"), rank.alias("rank"))
        rows.append(hit.orderBy(F.col("rank").desc_nulls_last(), "key").limit(n))
    return reduce(DataFrame.unionByName, rows)


def history_by_year(tables: dict[str, tuple[DataFrame, str, Column]], q: str) -> DataFrame:
    """``year, n`` of the rows of current and older tables that hold all words of ``q``; ``tables``: name to (df, text, year)."""
    hits = [df.where(text_matches(F.col(text), F.array(F.lit(q)))).select(year.alias("year")) for df, text, year in tables.values()]
    return reduce(DataFrame.unionByName, hits).where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("n"))


def due(monitors: DataFrame, as_of, most: int = 25) -> DataFrame:
    """Active monitors whose turn has come, the longest waiting first."""
    return monitors.where(F.col("active") & (F.col("next_run") <= F.lit(as_of))).orderBy("next_run", "monitor_id").limit(most)


def match_by_token(records: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """``monitor_id, key`` for rules of whole words, by way of the rarest word: an equi-join instead of rules times records.

    For very many rules.  A term matches if all its words are words of the text;
    that is narrower than the substring rule, so this is a choice of the caller.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(fold_accents(c, True), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))
    tokens = records.select(F.col(key).alias("key"), words(F.col(text)).alias("_words"))
    terms = rules.select(
        "monitor_id", F.explode(effective_terms(F.col("include"), F.col("approved"))).alias("_t")
    ).select("monitor_id", words(F.col("_t")).alias("_need")).where(F.size("_need") > 0)
    by_word = tokens.select("key", "_words", F.explode("_words").alias("_w"))
    wanted = terms.select(F.explode("_need").alias("_w")).distinct()
    counts = by_word.select("_w").join(wanted, "_w", "left_semi").groupBy("_w").agg(F.count("*").alias("_n"))
    spread = terms.withColumn("_w", F.explode("_need")).join(counts, "_w", "left").fillna(0, ["_n"])
    rarest = spread.groupBy("monitor_id", "_need").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
    return by_word.join(rarest, "_w").where(F.size(F.array_except("_need", "_words")) == 0).select("monitor_id", "key").distinct()


def dashboard(matches: DataFrame, awards: DataFrame, alerts: DataFrame, contracts: DataFrame, as_of, n: int = 10) -> dict[str, DataFrame]:
    """Sections of the monitors' dashboards, each a flat table keyed by monitor.

    ``alerts``: ``monitor_id, key, type, importance, raised_at``; ``contracts``: those
    that each monitor remembers, ``monitor_id, key, ends, value``.
    """
    place = lambda df, by, k: df.withColumn("place", F.row_number().over(Window.partitionBy("monitor_id").orderBy(*by))).where(F.col("place") <= k)
    open_ = matches.where(F.col("closes") > F.lit(as_of))
    agencies = matches.groupBy("monitor_id", "agency").agg(F.count("*").alias("processes"), money("value").alias("total_value"))
    return {
        "now": open_.groupBy("monitor_id").agg(F.count("*").alias("open"), money("value").alias("open_value")),
        "market": matches.groupBy("monitor_id").agg(F.count("*").alias("matches"), money("value").alias("total_value")),
        "open": place(open_, [F.col("closes"), F.col("key")], 3 * n),
        "competitors": competitors(matches, awards, n),
        "agencies": place(agencies, [F.col("total_value").desc_nulls_last(), F.col("agency")], n),
        "map": matches.where(F.col("state").isNotNull()).groupBy("monitor_id", "state").agg(F.count("*").alias("processes"), money("value").alias("total_value")),
        "states": place(matches.groupBy("monitor_id", "state").agg(money("value").alias("total_value")), [F.col("total_value").desc_nulls_last(), F.col("state")], n),
        "series": matches.groupBy("monitor_id", F.date_format("published", "yyyy-MM").alias("month")).agg(F.count("*").alias("processes"), money("value").alias("total_value")),
        "future": place(contracts, [F.col("ends"), F.col("key")], 2 * n),
        "future_value": contracts.groupBy("monitor_id").agg(F.count("*").alias("contracts"), money("value").alias("total_value")),
        "timeline": place(alerts, [F.col("raised_at").desc(), F.col("key"), F.col("type")], 4 * n),
    }
