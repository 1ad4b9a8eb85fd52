"""Parsing and landing on the driver's tables: pages as HTML, orders and events as payloads and files."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tendril.catalog import query, table
from tendril.functions import parse as P
from tendril.functions.text import decode_entities, label80, process_key, register_functions, slug
from tendril.operators.market import last_n
from tendril.sources import content as C
from tendril.sources import delimited as D
from tendril.sources import html as W
from tendril.sources import payloads as N
from tendril.sources import quoted as Q


@query(
    "parse_numbers",
    """SELECT o_orderkey, round(o_totalprice, 2) AS amount, CAST(o_custkey * 1000 + 125 AS DOUBLE) AS dotted, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) + 0.5 END AS plain FROM orders"""
)
def parse_numbers(spark, d):
    o = table(spark, d, "orders")
    label = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    plain = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.col("o_custkey"), F.lit(".5")))
    return o.select(
        "o_orderkey", F.round(P.br_number(F.concat(F.lit("R$ "), label)), 2).alias("amount"),
        P.br_number(F.concat(F.col("o_custkey"), F.lit(".125"))).alias("dotted"), P.number_or_null(plain).alias("plain")
    )


@query("parse_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS strict,
   CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS impossible, strftime(o_orderdate, '%Y-%m-%d') AS lenient, strftime(o_orderdate, '%Y-%m-%d 10:30') AS at_time,
 strftime(o_orderdate, '%d/%m/%Y') AS epoch, strftime(date_trunc('month', o_orderdate), '%Y%m%d') AS first_day, strftime(last_day(o_orderdate), '%Y%m%d') AS last_day FROM orders""")
def parse_dates(spark, d):
    br = F.date_format("o_orderdate", "dd/MM/yyyy")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    first, last = P.month_window(F.year("o_orderdate"), F.month("o_orderdate"))
    return table(spark, d, "orders").select(
        "o_orderkey", iso(P.br_date(br)).alias("strict"), iso(
            P.br_date(F.when(F.col("o_orderkey") % 2 == 0, br).otherwise(F.concat(F.lit("31/02/"), F.year("o_orderdate"))))
        ).alias("impossible"), iso(P.br_date_lenient(F.concat(br, F.lit(" 09:00")))).alias("lenient"),
        F.date_format(
            P.br_datetime_at(F.concat(br, F.lit(" às 10:30"))), "yyyy-MM-dd HH:mm"
        ).alias("at_time"), P.epoch_ms_label(ms).alias("epoch"), first.alias("first_day"), last.alias("last_day"),
    )


def _cnpj_sql(n: int, weights: list[int]) -> str:
    return " + ".join(f"CAST(substr(b, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(weights))


@query("valid_cnpj", f"""WITH a AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 AS VARCHAR), 8, '0') || '0001' AS b
   FROM customer), x AS (SELECT *, ({_cnpj_sql(12, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])}) % 11 AS r FROM a),
 y AS (SELECT c_custkey, b || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS b FROM x), z AS (SELECT *, ({_cnpj_sql(13, [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])}) % 11 AS r FROM y)
 SELECT c_custkey, CAST(CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS INT) = c_custkey % 10 AS valid FROM z""")
def valid_cnpj(spark, d):
    base = F.concat(F.lpad((F.col("c_custkey") * 7919).cast("string"), 8, "0"), F.lit("0001"))
    first = P._check_digit(base, [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
    c = table(spark, d, "customer").select("c_custkey", F.concat(base, first.cast("string"), (F.col("c_custkey") % 10).cast("string")).alias("n"))
    formatted = F.regexp_replace("n", r"^(\d{2})(\d{3})(\d{3})(\d{4})(\d{2})$", r"$1.$2.$3/$4-$5")
    return c.select("c_custkey", P.valid_cnpj(formatted).alias("valid"))


@query(
    "normalize_ids",
    r"""SELECT o_orderkey, 'doc-' || lower(replace(o_orderpriority, ' ', '-')) AS slug, CAST(o_orderkey AS VARCHAR) AS digits, CASE o_orderstatus WHEN 'O' THEN 'EMPENHO' WHEN 'F' THEN 'LIQUIDACAO' ELSE NULL END AS phase, CASE o_orderkey % 6 WHEN 0 THEN 'contratacoes' WHEN 1 THEN 'resultados' WHEN 2 THEN 'itens' WHEN 3 THEN 'arquivos' WHEN 4 THEN 'contratos' ELSE 'outro' END AS context, CASE WHEN o_orderkey % 3 = 0 THEN 'zip' ELSE 'pdf' END AS ext FROM orders"""
)
def normalize_ids(spark, d):
    k = F.col("o_orderkey")
    path = F.element_at(
        F.array(*map(F.lit, ("/contratacoes/1/itens", "/resultados/itens", "/itens", "/arquivos/contratos", "/contratos", "/contratacoes"))),
        (k % 6 + 1).cast("int")
    )
    url = F.concat(
        F.lit("https://x.example/v1"), path, F.when(k % 6 == 5, F.lit("")).otherwise(F.lit("/")),
        F.when(k % 3 == 0, F.lit("a.ZIP?x=1")).when(k % 6 == 5, F.lit("")).otherwise(F.lit("a"))
    )
    phase = P.expense_phase(F.when(F.col("o_orderstatus") == "O", "Nota de Empenho").when(F.col("o_orderstatus") == "F", "Liquidação").otherwise("outra"))
    return table(spark, d, "orders").select(
        "o_orderkey", slug(F.concat(F.lit(" Döc "), F.col("o_orderpriority"), F.lit("!"))).alias("slug"),
        P.digits(F.concat(F.lit("n. "), k)).alias("digits"), phase.alias("phase"), P.url_context(url).alias("context"),
        P.url_extension(url, F.lit("application/pdf")).alias("ext")
    )


@query("labels80", "SELECT doc_id, lower(left(trim(text), 80)) AS label FROM documents")
def labels80(spark, d):
    return table(spark, d, "documents").select("doc_id", label80(F.col("text")).alias("label"))


def _tender_json():
    return F.to_json(F.struct(
        F.concat(
            F.lpad(F.col("o_custkey").cast("string"), 14, "0"), F.lit("-1-"), F.col("o_orderkey"), F.lit("/"), F.year("o_orderdate")
        ).alias("numeroControlePNCP"), F.year("o_orderdate").alias("anoCompra"), F.col("o_orderkey").alias("sequencialCompra"),
        F.col("o_orderpriority").alias("modalidadeNome"), F.col("o_orderstatus").alias("situacaoCompraNome"), F.when(
            F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")
        ).alias("valorTotalEstimado"), (F.col("o_orderkey") % 3 == 0).alias("srp"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("dataPublicacaoPncp"), F.struct(
            F.lpad(F.col("o_custkey").cast("string"), 14, "0").alias("cnpj")
        ).alias("orgaoEntidade"), F.struct(F.when(F.col("o_orderkey") % 4 == 0, "ZZ").otherwise("CE").alias("ufSigla")).alias("unidadeOrgao"),
    ))


def _raw(spark, d):
    return table(spark, d, "orders").select(F.concat(F.lit("https://source.example/"), F.col("o_orderkey")).alias("url"), "o_orderkey", _tender_json().alias("payload"))


@query("normalize_tenders", """SELECT lpad(CAST(o_custkey AS VARCHAR), 14, '0') || '-1-' || o_orderkey || '/' || year(o_orderdate) AS key, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS modality, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS estimated_value, o_orderkey % 3 = 0 AS price_register,
 CASE WHEN o_orderkey % 4 = 0 THEN 'ZZ' ELSE 'CE' END AS state, strftime(o_orderdate, '%Y-%m-%d') AS published, CAST(NULL AS VARCHAR) AS notes FROM orders""")
def normalize_tenders(spark, d):
    return N.normalize_tenders(_raw(spark, d)).select(
        "key", "year", "modality", F.col("estimated_value").cast("double").alias("estimated_value"), "price_register", "state",
        F.date_format("published_at", "yyyy-MM-dd").alias("published"), "notes"
    )


@query("tender_issues", "SELECT 'state' AS field, 'invalid state' AS problem, 'ZZ' AS value, count(*) AS n FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1")
def tender_issues(spark, d):
    i = N.tender_issues(N.normalize_tenders(_raw(spark, d)))
    return i.where(F.col("problem") == "invalid state").groupBy("field", "problem", "value").agg(F.count("*").alias("n"))


@query("explode_items", "SELECT l_orderkey, l_linenumber AS item, l_quantity AS quantity, l_extendedprice AS total FROM lineitem")
def explode_items(spark, d):
    """Items nested in their tender's payload, taken apart again; a payload of one item need not be a list."""
    one = F.to_json(F.struct(F.col("l_linenumber").alias("numeroItem"), F.col("l_quantity").alias("quantidade"), F.col("l_extendedprice").alias("valorTotal")))
    many = table(spark, d, "lineitem").select("l_orderkey", one.alias("j")).groupBy("l_orderkey").agg(F.collect_list("j").alias("js"))
    payload = F.when(F.size("js") == 1, F.col("js")[0]).otherwise(F.concat(F.lit("["), F.array_join("js", ","), F.lit("]")))
    items = N.normalize_items(many.select("l_orderkey", payload.alias("payload")), "l_orderkey")
    return items.select("l_orderkey", F.col("item").cast("int").alias("item"), F.col("quantity").cast("double").alias("quantity"), F.col("total").cast("double").alias("total"))


@query(
    "catalog_resolution",
    """SELECT k AS code, CASE WHEN k % 3 = 0 THEN 'MATERIAL' WHEN k % 3 = 1 THEN 'SERVICO' ELSE 'NAO_ENCONTRADO_NA_FONTE' END AS kind, CASE WHEN k % 3 < 2 THEN p_name END AS description FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) LEFT JOIN part ON p_partkey = k"""
)
def catalog_resolution(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description"))
    return N.resolve_catalog(table(spark, d, "lineitem").select(F.col("l_partkey").alias("code")), p.where(F.col("code") % 3 == 0), p.where(F.col("code") % 3 <= 1))


@query(
    "land_raw",
    "SELECT url, html AS payload, sha256(coalesce(html, '')) AS sha256 FROM (SELECT DISTINCT url, html FROM pages) WHERE (url, html) NOT IN (SELECT (url, html) FROM pages WHERE page_id % 2 = 0)"
)
def land_raw(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.col("html").alias("payload"))
    at = datetime(2024, 1, 1)
    current = C.land_raw(p.limit(0).select("url", F.lit("").alias("sha256")), p.where(F.col("page_id") % 2 == 0).drop("page_id"), at)
    return C.land_raw(current, p.drop("page_id"), at).drop("collected_at")


def _json(struct: str, source) -> Column:
    return F.to_json(F.struct(*source)).alias(struct)


_DAY = "strftime({}, '%Y-%m-%d')"


@query(
    "normalize_contracts",
    f"""SELECT 'c' || l_orderkey || '/' || l_linenumber AS key, CAST(l_orderkey AS VARCHAR) AS tender_key, CAST(l_suppkey AS VARCHAR) AS supplier_id, l_extendedprice AS global_value, CASE WHEN l_linenumber = 1 THEN {_DAY.format('l_shipdate')} END AS ends, CAST(l_linenumber AS BIGINT) AS sequence FROM lineitem"""
)
def normalize_contracts(spark, d):
    """Contracts, of which some have the other spelling of the tender's key and some no end."""
    k = F.col("l_orderkey").cast("string")
    even = F.col("l_orderkey") % 2 == 0
    payload = _json("payload", [
        F.concat(
            F.lit("c"), k, F.lit("/"), F.col("l_linenumber")
        ).alias("numeroControlePNCP"), F.when(even, k).alias("numeroControlePncpCompra"), F.when(~even, k).alias("numeroControlePNCPCompra"), F.col("l_suppkey").cast("string").alias("niFornecedor"),
        F.col("l_extendedprice").alias("valorGlobal"), F.when(
            F.col("l_linenumber") == 1, F.date_format("l_shipdate", "yyyy-MM-dd")
        ).alias("dataVigenciaFim"), F.col("l_linenumber").alias("sequencialContrato"),
    ])
    c = N.normalize_contracts(table(spark, d, "lineitem").select(payload))
    return c.select("key", "tender_key", "supplier_id", F.col("global_value").cast("double").alias("global_value"), F.date_format("ends", "yyyy-MM-dd").alias("ends"), "sequence")


@query(
    "normalize_awards",
    "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS item, coalesce(CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_suppkey AS VARCHAR) END, '-') AS supplier_key, CAST(coalesce(CASE WHEN l_linenumber > 2 THEN l_linenumber END, 0) AS BIGINT) AS sequence_key, l_extendedprice AS total, strftime(l_shipdate, '%Y-%m-%d') AS result_date FROM lineitem WHERE l_linenumber <> 4"
)
def normalize_awards(spark, d):
    n = F.col("l_linenumber")
    payload = _json(
        "payload",
        [
            F.when(n != 4, n).alias("numeroItem"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey").cast("string")).alias("niFornecedor"),
            F.when(n > 2, n).alias("sequencialResultado"), F.col("l_extendedprice").alias("valorTotalHomologado"),
            F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("dataResultado")
        ]
    )
    a = N.normalize_awards(table(spark, d, "lineitem").select("l_orderkey", payload), "l_orderkey")
    return a.select(
        "l_orderkey", "item", "supplier_key", "sequence_key", F.col("total").cast("double").alias("total"),
        F.date_format("result_date", "yyyy-MM-dd").alias("result_date")
    )


@query(
    "normalize_documents",
    "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END AS sequence_key, coalesce(CASE WHEN page_id % 5 > 0 THEN url END, '-') AS url_key, 'kind' AS kind, page_id % 3 = 0 AS active FROM pages"
)
def normalize_documents(spark, d):
    k = F.col("page_id")
    url = F.when(k % 5 > 0, F.col("url"))
    payload = _json(
        "payload",
        [
            F.when(k % 2 == 0, k).alias("sequencialDocumento"), F.when(k % 2 == 0, url).alias("url"), F.when(k % 2 == 1, url).alias("uri"),
            F.when(k % 2 == 0, F.lit("kind")).alias("tipoDocumentoNome"), F.lit("kind").alias("tipoDocumentoDescricao"),
            (k % 3 == 0).alias("statusAtivo")
        ]
    )
    return N.normalize_documents(table(spark, d, "pages").select("page_id", payload), "page_id").select("page_id", "sequence_key", "url_key", "kind", "active")


@query(
    "normalize_plan_items",
    "SELECT CAST(p_brand AS VARCHAR) AS agency_id, CAST(2000 + p_size % 3 AS INT) AS plan_year, CAST(p_partkey AS BIGINT) AS item, p_name AS description, p_retailprice AS total FROM part"
)
def normalize_plan_items(spark, d):
    """Plans as envelopes of their items."""
    item = F.struct(
        F.col("p_partkey").alias("numeroItem"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("descricao"),
        F.when(F.col("p_partkey") % 2 == 1, F.col("p_name")).alias("descricaoItem"), F.col("p_retailprice").alias("valorTotal")
    )
    plans = table(spark, d, "part").groupBy(F.col("p_brand").alias("orgaoEntidadeCnpj"), (F.col("p_size") % 3 + 2000).alias("anoPca")).agg(F.collect_list(item).alias("itens"))
    items = N.normalize_plan_items(plans.select(_json("payload", ["*"])))
    return items.select("agency_id", "plan_year", "item", "description", F.col("total").cast("double").alias("total"))


@query(
    "normalize_registers",
    "SELECT 'r' || o_orderkey AS key, CAST(year(o_orderdate) AS BIGINT) AS year, strftime(o_orderdate, '%Y-%m-%d') AS starts, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS cancelled FROM orders"
)
def normalize_registers(spark, d):
    """Registers; what is no JSON boolean is not known to be cancelled."""
    payload = _json(
        "payload",
        [
            F.concat(F.lit("r"), F.col("o_orderkey")).alias("numeroControlePNCPAta"), F.year("o_orderdate").alias("anoAta"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("vigenciaInicio"),
            F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("cancelado")
        ]
    )
    r = N.normalize_registers(
        table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", F.replace(payload, F.lit("}"), F.lit(',"cancelado":"talvez"}'))).otherwise(payload).alias("payload"))
    )
    return r.select("key", "year", F.date_format("starts", "yyyy-MM-dd").alias("starts"), "cancelled")


@query(
    "normalize_execution",
    "SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, 'commitments' AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'n' ELSE 'i' END || l_linenumber AS record_key, CAST(l_partkey AS DOUBLE) * 1000 + 0.5 AS empenhado, strftime(l_shipdate, '%Y-%m-%d') AS date FROM lineitem"
)
def normalize_execution(spark, d):
    n = F.col("l_linenumber")
    payload = _json(
        "payload",
        [
            F.when(n % 2 == 0, F.concat(F.lit("n"), n)).alias("numero"), F.concat(F.lit("i"), n).alias("id"),
            F.concat(F.col("l_partkey"), F.lit(".000,50")).alias("empenhado"),
            F.when(n % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy")).alias("data_emissao"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("emissao")
        ]
    )
    x = N.normalize_execution(table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("contract_id"), payload), "commitments")
    return x.select(
        "contract_id", "kind", "record_key", F.when(F.col("empenhado") < 1, F.col("empenhado") * 1).otherwise(F.col("empenhado")).alias("empenhado"),
        F.date_format("date", "yyyy-MM-dd").alias("date")
    )


@query("normalize_execution_feeds", """SELECT CAST(l_orderkey AS VARCHAR) AS contract_id, k.kind, l_linenumber % 3 AS named, CASE l_linenumber % 3 WHEN 0 THEN 'n' || l_linenumber WHEN 1 THEN 'i' || l_linenumber ELSE '24' END AS record, count(*) AS n,
 strftime(max(l_shipdate), '%Y-%m-%d') AS last FROM lineitem, (SELECT unnest(['invoices', 'guarantees', 'incidents']) AS kind) k GROUP BY ALL""")
def normalize_execution_feeds(spark, d):
    """Invoices, guarantees and incidents of contracts: keys are numbers, ids, or 24 digits of a hash where there is neither."""
    k = F.col("l_linenumber")
    name = {0: "numero", 1: "id"}
    base = table(spark, d, "lineitem")
    said = [F.when(k % 3 == m, F.concat(F.lit(v[0]), k)).alias(v) for m, v in name.items()]
    payload = F.to_json(F.struct(*said, F.date_format("l_shipdate", "dd/MM/yyyy").alias("emissao"), F.monotonically_increasing_id().alias("linha")))
    raw = base.select(F.col("l_orderkey").cast("string").alias("contract_id"), payload.alias("payload"))
    every = N.normalize_execution_feeds(raw, ("invoices", "guarantees", "incidents"))
    hashed = F.length("record_key") == 24
    named = F.when(hashed, 2).when(F.col("record_key").startswith("n"), 0).otherwise(1).cast("long")
    return every.groupBy(
        "contract_id", "kind", named.alias("named"), F.when(hashed, "24").otherwise(F.col("record_key")).alias("record")
    ).agg(F.count("*").alias("n"), F.date_format(F.max("date"), "yyyy-MM-dd").alias("last"))


@query(
    "normalize_payments",
    "SELECT 'PAGAMENTO' AS phase, 'PAGAMENTO:' || event_id AS record_key, CAST(user_id AS VARCHAR) AS supplier_id, strftime(ts, '%Y-%m-%d') AS date FROM events"
)
def normalize_payments(spark, d):
    payload = _json(
        "payload",
        [
            F.lit("Pagamento").alias("fase"), F.col("event_id").alias("documento"),
            F.concat(F.lit("n. "), F.col("user_id")).alias("codigoFavorecido"), F.date_format("ts", "dd/MM/yyyy").alias("data")
        ]
    )
    return N.normalize_payments(table(spark, d, "events").select(payload)).select("phase", "record_key", "supplier_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(
    "normalize_prices",
    "SELECT l_partkey AS code, CASE WHEN l_partkey % 3 = 0 THEN 'MATERIAL' ELSE 'SERVICO' END AS kind, CAST(l_suppkey AS VARCHAR) AS supplier_id, l_extendedprice AS unit_price, strftime(l_shipdate, '%Y-%m-%d') AS bought, count(*) OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS same FROM lineitem WHERE l_partkey % 3 < 2"
)
def normalize_prices(spark, d):
    """Prices of the codes that the catalogue knows, and how many have the same key."""
    from pyspark.sql.window import Window

    p = table(spark, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("description"))
    i = table(spark, d, "lineitem")
    known = N.resolve_catalog(i.select(F.col("l_partkey").alias("code")), p.where(F.col("code") % 3 == 0), p.where(F.col("code") % 3 == 1))
    payload = _json(
        "payload",
        [
            F.col("l_orderkey").alias("idCompra"), F.col("l_linenumber").alias("numeroItemCompra"), F.col("l_extendedprice").alias("precoUnitario"),
            F.concat(F.lit("n/"), F.col("l_suppkey")).alias("cnpjFornecedor"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("dataCompra")
        ]
    )
    prices = N.normalize_prices(i.select(F.col("l_partkey").alias("code"), payload), known)
    same = F.count("*").over(Window.partitionBy("price_key"))
    return prices.select(
        "code", "kind", "supplier_id", F.col("unit_price").cast("double").alias("unit_price"), F.date_format("bought", "yyyy-MM-dd").alias("bought"),
        same.alias("same")
    )


@query(
    "register_balances",
    "SELECT l.o_orderkey AS register, CAST(i.l_linenumber AS BIGINT) AS item, i.l_quantity AS balance, i.l_linenumber IS NULL AS sentinel FROM orders l LEFT JOIN lineitem i ON l_orderkey = o_orderkey AND o_orderkey % 4 <> 0"
)
def register_balances(spark, d):
    """Balances of registers, with a sentinel for those that have none."""
    item = F.struct(F.col("l_linenumber").alias("numeroItem"), F.col("l_quantity").alias("saldo"), F.col("l_partkey").cast("string").alias("codigoItem"))
    found = table(spark, d, "lineitem").where(F.col("l_orderkey") % 4 != 0).groupBy(F.col("l_orderkey").alias("register")).agg(F.collect_list(item).alias("resultado"))
    rows = N.normalize_balances(found.select("register", F.to_json(F.struct("resultado")).alias("payload")), "register")
    every = N.balances(table(spark, d, "orders").select(F.col("o_orderkey").alias("register")), rows, "register")
    return every.select("register", "item", F.col("balance").cast("double").alias("balance"), (F.col("record_key") == N.NO_RECORDS).alias("sentinel"))


def _files(spark, name: str) -> str:
    from tendril.queries.streams import shared_folder

    return shared_folder(spark, name)


@query(
    "read_delimited",
    "SELECT CAST(o_orderkey AS VARCHAR) AS numero, 'Órgão; \"' || o_custkey || chr(34) || chr(10) || o_orderpriority AS objeto, CAST(o_totalprice AS DOUBLE) AS valor FROM orders WHERE o_orderkey % 5 <> 0".replace('\\"', '"')
)
def read_delimited(spark, d):
    """Orders as quoted Latin-1 files with separators, quotes and line ends in their fields; rows without a number are set apart."""
    o = table(spark, d, "orders")
    text = F.concat(F.lit('Órgão; "'), F.col("o_custkey"), F.lit('"\n'), F.col("o_orderpriority"))
    folder = _files(spark, "csv")
    o.select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("Número"), text.alias("Objeto"),
        F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("Valor")
    ).write.options(header=True, sep=";", quote='"', escape='"', encoding="ISO-8859-1", quoteAll=True, lineSep="\n").csv(folder)
    good, _ = D.quarantine(D.read_delimited(spark, folder), ["Número"])
    return good.select(F.col("Número").alias("numero"), F.col("Objeto").alias("objeto"), P.br_number(F.col("Valor")).alias("valor"))


@query("quarantine", "SELECT 'missing number' AS error, 'id ' || o_orderkey AS id, count(*) OVER () AS n, 'part-' || (o_orderkey % 3) AS file FROM orders WHERE o_orderkey % 5 = 0")
def quarantine(spark, d):
    """What was set apart, with its file, its error and the start of its line."""
    o = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("number"), F.concat(F.lit("id "), F.col("o_orderkey")).alias("id"),
        (F.col("o_orderkey") % 3).alias("part")
    )
    folder = _files(spark, "csv")
    for k in range(3):
        o.where(F.col("part") == k).drop("part").coalesce(1).write.options(header=True, sep=";", quoteAll=True, escape='"').csv(f"{folder}/part-{k}")
    _, bad = D.quarantine(D.numbered(D.read_delimited(spark, f"{folder}/*", encoding="UTF-8")), ["number"])
    named = bad.where(F.col("line") > 0).withColumn("file", F.regexp_extract("file", "(part-[0-9])/", 1))
    n = named.agg(F.count("*").alias("n"))  # a single row
    return named.crossJoin(F.broadcast(n)).select("error", F.get_json_object("content", "$.id").alias("id"), "n", "file")


_QUOTED = """r AS (SELECT o_orderkey, 2 + sum(1 + CASE WHEN o_orderkey % 4 = 1 THEN 2
   ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS number, 'é "' || o_orderpriority || '"' ||
   CASE WHEN o_orderkey % 4 = 1 THEN chr(10) || ';' || chr(10) || 'end' ELSE '' END AS object FROM orders)"""


def _quoted_file(spark, d, name: str) -> str:
    """Orders as one file of quoted fields, some over three lines, in order of their keys."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit('é "'), F.col("o_orderpriority"), F.lit('"'), F.when(k % 4 == 1, F.lit("\n;\nend")).otherwise(F.lit("")))
    rows = table(spark, d, "orders").orderBy("o_orderkey").select(
        F.when(k % 7 != 0, k.cast("string")).otherwise("").alias("Número"), text.alias("Objeto"), k.cast("string").alias("Chave")
    )
    folder = _files(spark, name)
    rows.coalesce(1).write.options(header=True, sep=";", quoteAll=True, escape='"', encoding="ISO-8859-1", lineSep="\n").csv(folder)
    return folder


#: A file of the test tables has so many splits at most, unless they would be larger than the session's.
_SPLITS = 64


def _split_size(spark, folder: str, least: str) -> str:
    """The size of splits that give a folder's files ``_SPLITS`` of them, ``least`` kilobytes at least and the session's size at most."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    held = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return f"{min(max(int(least.removesuffix('k')) << 10, held // _SPLITS), most)}b"


@contextmanager
def _small_splits(spark, folder: str, least: str):
    """Splits of some kilobytes, so that a file of the test tables has many; a larger file has larger ones, not ever more."""
    names = {"spark.sql.files.maxPartitionBytes": _split_size(spark, folder, least), "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@query("quoted_parallel", f"WITH {_QUOTED} SELECT CAST(number AS VARCHAR) AS number, object, CAST(o_orderkey AS VARCHAR) AS id, CAST(coalesce(before, 2) AS BIGINT) AS line FROM r")
def quoted_parallel(spark, d):
    """One file read by many tasks: records, each with the physical line that it begins at."""
    folder = _quoted_file(spark, d, "quoted")
    with _small_splits(spark, folder, "20k"):
        rows = Q.read_quoted(spark, folder)
        kept = _files(spark, "quoted-rows")
        rows.select(F.col("Número").alias("number"), F.col("Objeto").alias("object"), F.col("Chave").alias("id"), F.col("_line").alias("line")).write.parquet(kept)
    return spark.read.schema("number string, object string, id string, line long").parquet(kept)


@query(
    "quoted_quarantine",
    f"WITH {_QUOTED} SELECT 'missing Número' AS error, CAST(o_orderkey AS VARCHAR) AS id, CAST(coalesce(before, 2) AS BIGINT) AS line, 'part' AS file FROM r WHERE number IS NULL"
)
def quoted_quarantine(spark, d):
    """Records without a number, found by file and line."""
    folder = _quoted_file(spark, d, "quoted")
    with _small_splits(spark, folder, "20k"):
        _, bad = D.quarantine(Q.read_quoted(spark, folder), ["Número"])
        kept = _files(spark, "quoted-bad")
        bad.select("error", F.get_json_object("content", "$.Chave").alias("id"), "line", F.regexp_extract("file", "/(part)-[^/]*csv$", 1).alias("file")).write.parquet(kept)
    return spark.read.schema("error string, id string, line long, file string").parquet(kept)


@query(
    "quoted_resume",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(CASE WHEN o_orderkey <= (SELECT quantile_disc(o_orderkey, 0.5) FROM orders) THEN 1 ELSE 2 END AS INT) AS load FROM orders"
)
def quoted_resume(spark, d):
    """A load that stops halfway and goes on from the byte that it came to: every record once."""
    folder = _quoted_file(spark, d, "quoted")
    kept = _files(spark, "quoted-loads")
    with _small_splits(spark, folder, "20k"):
        rows = Q.read_quoted(spark, folder)
        half = table(spark, d, "orders").selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey) AS k").first()[0]
        first = rows.where(F.col("Chave").cast("long") <= F.lit(half))
        first.select(F.col("Chave").alias("id"), F.lit(1).alias("load")).write.parquet(f"{kept}/1")
        rest = Q.read_quoted(spark, folder, after=Q.loaded(first))
        rest.select(F.col("Chave").alias("id"), F.lit(2).alias("load")).write.parquet(f"{kept}/2")
    return spark.read.schema("id string, load int").parquet(f"{kept}/1", f"{kept}/2")


@query("read_mapped", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS agency, CAST(NULL AS VARCHAR) AS missing FROM supplier")
def read_mapped(spark, d):
    """A file whose header is known by fragments of its names only."""
    folder = _files(spark, "mapped")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("Número do Processo"), F.col("s_name").alias("Nome do Órgão")).write.options(header=True).csv(folder)
    columns = {"key": [["numero", "licitacao"], ["numero", "processo"]], "agency": [["orgao"]], "missing": [["xyz"]]}
    return D.read_mapped(spark, folder, columns, "key").drop(D.CORRUPT)


@query("read_period", "SELECT 'items' AS role, CAST(p_partkey AS VARCHAR) AS id FROM part UNION ALL SELECT 'tenders', CAST(o_orderkey AS VARCHAR) FROM orders")
def read_period(spark, d):
    """A month's files by their names' roles; one has no role."""
    base = _files(spark, "period")
    paths = {f"{base}/202401_Licitacao.csv": ("orders", "o_orderkey"), f"{base}/202401_ItemLicitacao.csv": ("part", "p_partkey"), f"{base}/readme.csv": ("region", "r_regionkey")}
    for path, (name, key) in paths.items():
        table(spark, d, name).select(F.col(key).alias("id")).write.options(header=True, sep=";").csv(path)
    found = D.read_period(spark, list(paths))
    return found["items"].select(F.lit("items").alias("role"), "id").unionByName(found["tenders"].select(F.lit("tenders").alias("role"), "id"))


@query("read_passthrough", "SELECT CAST(s_suppkey AS VARCHAR) AS codigo_unico, s_name AS name, 2 AS fields FROM supplier")
def read_passthrough(spark, d):
    folder = _files(spark, "passthrough")
    table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("Código Único"), F.col("s_name").alias("Nome")
    ).write.options(header=True, sep=";", encoding="ISO-8859-1").csv(folder)
    return D.read_passthrough(spark, folder).select("codigo_unico", F.col("data")["nome"].alias("name"), F.size("data").alias("fields"))


@query("form_fields", "SELECT page_id, 'v' || page_id || '&' AS uf, CAST(NULL AS VARCHAR) AS none FROM pages")
def form_fields(spark, d):
    p = table(spark, d, "pages").withColumn("html", F.concat("html", F.lit('<input type="text" id="uf"\n value="v'), F.col("page_id"), F.lit('&amp;"><input id="none">')))
    return p.select("page_id", *W.form_fields(F.col("html"), ["uf", "none"]))


@query("files_in_json", "SELECT page_id, 'Edital ' || page_id AS title, '01/02/2024' AS created, url FROM pages WHERE page_id % 3 <> 0")
def files_in_json(spark, d):
    """Tables of files inside payloads; some payloads are no JSON."""
    k = F.col("page_id")
    html = F.concat(F.lit("<table><tr><td>Edital "), k, F.lit("</td><td>01/02/2024</td><td><a href=\""), F.col("url"), F.lit('">x</a></td></tr></table>'))
    payload = F.when(k % 3 != 0, F.to_json(F.struct(html.alias("html")))).otherwise(F.lit("no json"))
    return W.files_in_json(table(spark, d, "pages").select("page_id", payload.alias("payload")), "payload", ["page_id"])


@query("listing_cards", "SELECT page_id, 'Prefeitura - ' || page_id AS agency, 'Recife' AS city, 'PE' AS state, page_id || '/2024' AS number FROM pages")
def listing_cards(spark, d):
    k = F.col("page_id")
    html = F.concat(F.lit("<h1>x</h1><section>Órgão: Prefeitura - "), k, F.lit(" - Recife / PE<br>Número: "), k, F.lit("/2024<br>"))
    return W.cards(table(spark, d, "pages").select("page_id", html.alias("html")), "html", "<section>", {"agency": "Órgão", "number": "Número"}, ["page_id"]).drop("card")


@query(
    "content_files",
    "SELECT source, count(*) AS links, count(DISTINCT source || lang) AS contents, 0 AS broken FROM (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY 1"
)
def content_files(spark, d):
    """Files as stored contents and links, read twice; what the store holds has its hash."""
    folder = _files(spark, "contents")
    docs = table(spark, d, "documents").where(F.col("source").isNotNull() & F.col("lang").isNotNull()).select("source", "lang").distinct()
    docs.select("source", "lang", F.concat("source", "lang").alias("value")).repartition("source", "lang").write.partitionBy("source", "lang").text(folder)
    at = datetime(2024, 1, 1)
    store, links = spark.createDataFrame([], "sha256 string, bytes long, content binary"), spark.createDataFrame(
        [], "source string, entity string, key string, sha256 string, first_seen timestamp, last_seen timestamp"
    )
    new, links = C.content_store(spark, folder, store, links, "s", "file", at)
    again, links = C.content_store(spark, folder, new, links, "s", "file", at)
    kept = new.unionByName(again)
    of = links.where(~F.col("key").contains("_SUCCESS")).withColumn("source", F.regexp_extract("key", "source=([^/]+)/", 1))
    broken = C.verify_store(kept).agg(F.count("*").cast("int").alias("broken"))
    return of.join(kept.select("sha256"), "sha256").groupBy("source").agg(F.count("*").alias("links"), F.countDistinct("sha256").alias("contents")).crossJoin(broken)


@query("replay", "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 3 = 0 THEN 'later' ELSE 'first' END AS object FROM orders")
def replay(spark, d):
    """Raw payloads landed twice, of which some changed, and the table rebuilt from all of them."""
    k = F.col("o_orderkey")
    raw = lambda text: table(spark, d, "orders").select(
        F.concat(F.lit("u"), k).alias("url"),
        F.to_json(F.struct(k.cast("string").alias("numeroControlePNCP"), text.alias("objetoCompra"))).alias("payload")
    )
    empty = spark.createDataFrame([], "url string, sha256 string")
    first = C.land_raw(empty, raw(F.lit("first")), datetime(2024, 1, 1))
    second = C.land_raw(first, raw(F.when(k % 3 == 0, "later").otherwise("first")), datetime(2024, 1, 2))
    landed = first.unionByName(second)
    return C.replay(landed, lambda rows: N.normalize_tenders(rows).select("key", "object"), ["key"]).select("key", "object")


@query(
    "materialize_monthly",
    "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN 2 ELSE 1 END) AS BIGINT) AS written FROM orders GROUP BY 1"
)
def materialize_monthly(spark, d):
    """Months written by several writers; those of one year are written again and replace what was there."""
    folder = _files(spark, "months")
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit(1).alias("written"))
    C.materialize_monthly(o, folder)
    C.materialize_monthly(o.where(F.col("month").startswith("1997")).withColumn("written", F.lit(2)), folder)
    return spark.read.schema("o_orderkey long, written int, month string").parquet(folder).groupBy("month").agg(F.count("*").alias("n"), F.sum("written").alias("written"))


@query(
    "json_parts",
    "SELECT event_id, 'object' AS kind, CASE WHEN event_id % 2 = 0 THEN 'array' WHEN event_id % 3 = 0 THEN 'string' ELSE 'number' END AS inner_kind, 'k' AS keys, CAST(0 AS INT) AS left_, event_id % 2 = 0 AS has, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS texts FROM events"
)
def json_parts(spark, d):
    """Kinds, keys and lists in JSON documents, and a document without one of its keys."""
    k = F.col("event_id")
    inner = F.when(k % 2 == 0, F.lit('["a","b"]')).when(k % 3 == 0, F.lit('"x"')).otherwise(k.cast("string"))
    doc = P.json_object(F.col("props"))
    e = table(spark, d, "events").withColumn("inner", inner)
    texts = P.string_array(F.when(k % 2 == 0, F.col("inner")), F.array(F.lit("default")))
    return e.select(
        "event_id", P.json_kind(F.col("props")).alias("kind"), P.json_kind(F.col("inner")).alias("inner_kind"),
        F.array_join(F.map_keys(doc), ",").alias("keys"), F.size(P.without_key(doc, "k")).alias("left_"), (F.size(texts) == 2).alias("has"),
        F.size(texts).alias("texts")
    )


@query("content_keys", "SELECT count(DISTINCT (coalesce(text, '?'), coalesce(lang, '?'))) AS keys, 24 AS length FROM documents")
def content_keys(spark, d):
    key = P.content_key([F.col("text"), F.col("lang")], 24)
    return table(spark, d, "documents").select(key.alias("k")).agg(F.countDistinct("k").alias("keys"), F.max(F.length("k")).alias("length"))


@query(
    "process_keys",
    "SELECT o_orderkey, o_custkey || ':' || left(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '', 'g'), 12) || ':' || o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
)
def process_keys(spark, d):
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    key = process_key(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", key.alias("key"), F.date_format(P.dotnet_date(F.concat(F.lit("/Date("), ms, F.lit(")/"))), "yyyy-MM-dd").alias("day"))


@query("sql_functions", "SELECT p_partkey, lower(p_name) AS folded, lower(p_name) LIKE '%red%' AND lower(p_name) LIKE '%gear%' AS ok FROM part")
def sql_functions(spark, d):
    """The functions that are registered for SQL."""
    register_functions(spark)
    return table(spark, d, "part").selectExpr("p_partkey", "fold_text(p_name) AS folded", "text_ok(p_name, array('GÉAR red', 'x')) AS ok")


@query("content_dedup", "SELECT sha256(text) AS sha256, min(doc_id) AS first_key, count(*) AS refs FROM documents GROUP BY 1")
def content_dedup(spark, d):
    return C.content_dedup(table(spark, d, "documents"), "doc_id", "text")


@query(
    "dataset_manifest",
    "SELECT event_type, strftime(ts, '%Y-%m') AS month, true AS digested, count(*) AS records, CAST(sum(strlen(props)) AS BIGINT) AS bytes, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date FROM events GROUP BY 1, 2"
)
def dataset_manifest(spark, d):
    """Parts with their digests, which a shuffled copy of the rows has too."""
    e = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    part = ["event_type", "month"]
    again = C.dataset_manifest(e.repartition(5, "event_id"), part, "ts", "props").select(*part, F.col("digest").alias("_again"))
    return C.dataset_manifest(e, part, "ts", "props").join(again, part).withColumn("digested", F.col("digest") == F.col("_again")).drop("digest", "_again")


@query(
    "extract_links",
    r"""SELECT page_id, string_agg(DISTINCT h, '|' ORDER BY h) AS hrefs, count(DISTINCT h) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS h FROM pages) GROUP BY 1"""
)
def extract_links(spark, d):
    p = table(spark, d, "pages").select("page_id", W.links(F.col("html")).alias("l"))
    return p.select("page_id", F.array_join(F.array_sort("l.hrefs"), "|").alias("hrefs"), F.size("l.hrefs").cast("long").alias("n")).where(F.col("n") > 0)


@query(
    "extract_rows",
    r"""SELECT page_id, CAST(k - 1 AS INT) AS row, trim(regexp_replace(regexp_replace(li, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM (SELECT page_id, unnest(l) AS li, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li[^>]*>(.*?)</li>', 1, 's') AS l FROM pages))"""
)
def extract_rows(spark, d):
    """Navigation entries, as rows of one cell once list items are written as table rows."""
    p = table(spark, d, "pages").select(
        "page_id",
        F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?s)<tr.*?</tr>", ""), r"<li[^>]*>", "<tr><td>"), "</li>", "</td></tr>").alias("html")
    )
    return W.listing_rows(p, "html", ["label"], ["page_id"])


def _flags_sql(names) -> str:
    return ", ".join("regexp_matches(html, '" + p.replace("'", "''") + f"', 'i') AS {n}" for n, p in names)


_FLAGS = (*W.FRAMEWORKS, *W.WALLS, *W.HINTS)


@query("fingerprint_pages", rf"""SELECT page_id,
   CASE WHEN regexp_matches(html, '<title[^>]*>[^<]{{1,200}}</title>', 'i') THEN trim(regexp_extract(html, '<title[^>]*>([^<]{{1,200}})</title>', 1, 'i')) END AS title,
 least(10, len(regexp_extract_all(html, '<form[^>]*action=["'']([^"'']*)["'']', 1, 'i'))) AS forms, least(10, len(regexp_extract_all(html, '<script[^>]+src=["'']([^"'']+)["'']', 1, 'i'))) AS scripts, {_flags_sql(_FLAGS)} FROM pages""")
def fingerprint_pages(spark, d):
    f = table(spark, d, "pages").select("page_id", W.fingerprint(F.col("html")).alias("f"))
    every = F.concat("f.frameworks", "f.walls", "f.hints")
    return f.select(
        "page_id", "f.title", F.size("f.forms").cast("long").alias("forms"), F.size("f.scripts").cast("long").alias("scripts"),
        *[F.array_contains(every, n).alias(n) for n, _ in _FLAGS]
    )


@query("keyword_context", r"""WITH s AS (SELECT doc_id, regexp_split_to_array(text, '(?i)thanin') AS p FROM documents WHERE lower(text) LIKE '%thanin%')
 SELECT doc_id, CAST(k AS INT) AS occurrence, right(p[k], 200) AS before, left(p[k + 1], 600) AS after
   FROM (SELECT doc_id, p, unnest(range(1, least(len(p) - 1, 15) + 1)) AS k FROM s)""")
def keyword_context(spark, d):
    return W.keyword_context(table(spark, d, "documents"), "text", "thanin", ["doc_id"])


@query(
    "decode_entities",
    "SELECT page_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS html FROM pages"
)
def decoded(spark, d):
    return table(spark, d, "pages").select("page_id", decode_entities(F.col("html")).alias("html"))


@query("json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS merged FROM events")
def json_fields(spark, d):
    doc = P.json_object(F.to_json(F.struct("props")))
    e = table(spark, d, "events").select(
        "event_id", "event_type", P.json_object(F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))).alias("m"),
        doc.alias("outer")
    )
    merged = P.map_merge(F.col("m"), F.create_map(F.lit("type"), F.col("event_type")))
    return e.select("event_id", F.col("m")["k"].alias("k"), merged["type"].alias("merged"))


@query("last_unique", "SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def last_unique(spark, d):
    e = last_n(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 1)
    return e.groupBy("user_id").agg(F.array_join(P.last_unique(F.array_sort(F.collect_list("event_type"))), ",").alias("kinds"))


@query(
    "change_pct",
    "SELECT event_id, CASE WHEN v0 > 0 THEN round((value - v0) / v0 * 100, 1) + 0.0 END AS pct FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v0 FROM events)"
)
def change_pct(spark, d):
    from pyspark.sql.window import Window

    v0 = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("v0", v0).select("event_id", P.pct_change(F.col("v0"), F.col("value")).alias("pct"))


@query("normalize_parties", """SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') || '000190' AS supplier_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS supplier_name,
 CASE WHEN s_suppkey % 3 <> 2 THEN '2024-03-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') END AS signed_on, 'Cidade ' || s_nationkey AS city,
   CASE WHEN s_suppkey % 5 <> 0 THEN 'UF' || s_nationkey % 9 END AS state FROM supplier""")
def normalize_parties(spark, d):
    """Suppliers, dates and places as contracts spell them: with and without marks and names, in two notations, some that are no dates."""
    k = F.col("s_suppkey")
    eight = F.lpad(k.cast("string"), 8, "0")
    marked = F.concat(F.substring(eight, 1, 2), F.lit("."), F.substring(eight, 3, 3), F.lit("."), F.substring(eight, 6, 3), F.lit("/0001-90"))
    number = F.when(k % 2 == 0, marked).otherwise(F.concat(eight, F.lit("000190")))
    day = F.lpad((1 + k % 28).cast("string"), 2, "0")
    rows = table(spark, d, "supplier").select(
        "s_suppkey", F.concat(number, F.when(k % 4 != 0, F.concat(F.lit(" - "), "s_name")).otherwise("")).alias("who"),
        F.when(k % 3 == 0, F.concat(day, F.lit("/03/2024"))).when(k % 3 == 1, F.concat(F.lit("2024-03-"), day, F.lit("T08:00"))).otherwise(F.lit("em breve")).alias("signed"),
        F.concat(F.lit("Cidade "), "s_nationkey", F.lit(" - "), F.when(k % 5 != 0, F.concat(F.lit("UF"), F.col("s_nationkey") % 9)).otherwise("")).alias("place"),
    )
    out = N.normalize_parties(rows, "who", "signed", "place")
    return out.select("s_suppkey", "supplier_id", "supplier_name", F.date_format("signed_on", "yyyy-MM-dd").alias("signed_on"), "city", "state")
