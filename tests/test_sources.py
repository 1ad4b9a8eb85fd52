"""Files with awkward lines, JSON payloads, HTML, contents, sinks."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tendril.sources import content as C
from tendril.sources import delimited as D
from tendril.sources import html as W
from tendril.sources import payloads as N


def test_delimited_multiline_and_quarantine(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_bytes('número;objeto;valor\n1;"linha 1\nlinha ""2""; fim";10,5\n;sem chave;1\n3;ok;2;sobra\n'.encode("latin-1"))
    df = D.read_delimited(spark, str(p))
    good, bad = D.quarantine(df, ["número"])
    assert [r["objeto"] for r in good.collect()] == ['linha 1\nlinha "2"; fim']
    assert sorted(r.error for r in bad.collect()) == ["malformed", "missing número"]


def test_mapped_header(spark, tmp_path):
    p = tmp_path / "y.csv"
    p.write_text("\ufeffNúmero do Processo,Nome do Órgão,Valor Total\n7,Saúde,1\n", encoding="utf-8")
    columns = {"key": [["numero", "licitacao"], ["numero", "processo"]], "agency": [["orgao"]], "missing": [["xyz"]]}
    assert [tuple(r)[:3] for r in D.read_mapped(spark, str(p), columns, "key").collect()] == [("7", "Saúde", None)]
    with pytest.raises(ValueError):
        D.read_mapped(spark, str(p), {"key": [["cnpj"]]}, "key")
    assert D.map_header(["Órgão Superior", "Órgão"], [["orgao", "superior"], ["orgao"]]) == 0 and D.map_header(["a"], [["b"]]) == -1


def test_period_and_passthrough(spark, tmp_path):
    names = {"202401_Licitação.csv": "tenders", "202401_ItemLicitação.csv": "items", "202401_ParticipantesLicitação.csv": "bidders", "x.csv": None}
    for n, role in names.items():
        assert D.file_role(n) == role
    p = tmp_path / "202401_Licitacao.csv"
    p.write_bytes("Número Único;Órgão\n1;é\n".encode("latin-1"))
    assert set(D.read_period(spark, [str(p)])) == {"tenders"}
    assert D.read_passthrough(spark, str(p)).first().data == {"numero_unico": "1", "orgao": "é"}


def test_payloads(spark):
    raw = spark.createDataFrame(
        [
            ('{"numeroControlePNCP": "k1", "srp": "sim", "anoCompra": 2024, "objetoCompra": ""}',),
            ('{"srp": true, "valorTotalEstimado": 0, "orgaoEntidade": {"cnpj": "11111111111111"}, "unidadeOrgao": {"ufSigla": "XX"}}',)
        ],
        "payload string"
    )
    a, b = N.normalize_tenders(raw).collect()
    assert a.key == "k1" and a.price_register is None and a.estimated_value is None and a.object == "" and a.year == 2024
    assert b.key is None and b.price_register is True and b.estimated_value == 0
    assert sorted(r.problem for r in N.tender_issues(N.normalize_tenders(raw)).collect()) == ["invalid cnpj", "invalid state", "missing key"]
    plans = spark.createDataFrame([('{"orgaoEntidadeCnpj": "1", "anoPca": 2024, "itens": [{"numeroItem": 1}, {"numeroItem": 2}]}',), ('{"numeroItem": 9}',)], "payload string")
    assert sorted(r.item for r in N.normalize_plan_items(plans).collect()) == [1, 2, 9]
    items = spark.createDataFrame([("t", '[{"numeroItem": 1, "catalogoCodigoItem": "c"}, {"descricao": "x"}]')], "tender_key string, payload string")
    assert [(r.tender_key, r.item, r.code) for r in N.normalize_items(items).collect()] == [("t", 1, "c")]
    pay = spark.createDataFrame([('{"fase": "Pagamento", "documento": "d1", "valor": "1.000,50", "data": "02/03/2024"}',), ('{"valor": ""}',)], "payload string")
    x, y = N.normalize_payments(pay).collect()
    assert (x.record_key, x.value, str(x.date)) == ("PAGAMENTO:d1", 1000.5, "2024-03-02") and y.value is None and len(y.record_key) == 32
    regs = spark.createDataFrame([("r1",), ("r2",)], "reg string")
    found = spark.createDataFrame([("r1", "x")], "reg string, record_key string")
    assert sorted(map(tuple, N.balances(regs, found, "reg").collect())) == [("r1", "x"), ("r2", N.NO_RECORDS)]


def test_html(spark):
    page = """<title> A &amp; B </title><script src="/jquery.js"></script><table><tr><td>1</td><td><b>x</b> y</td></tr><tr><td>only</td></tr></table>
    <input id="uf" type="text" value="S&atilde;o"><a href="/dados/2019/"></a><a href="x_2021.zip"></a><form action="/busca">"""
    df = spark.createDataFrame([(1, page)], "id int, html string")
    assert [(r.row, r.a, r.b) for r in W.listing_rows(df, "html", ["a", "b"], ["id"]).collect()] == [(0, "1", "x y")]
    assert df.select(*W.form_fields(F.col("html"), ["uf", "no"])).first().asDict() == {"uf": "São", "no": None}
    found = df.select(W.links(F.col("html")).alias("l")).first().l
    assert (found.folders, found.files, found.first_year, found.last_year) == (["/dados/2019/"], ["x_2021.zip"], 2019, 2021)
    f = df.select(W.fingerprint(F.col("html")).alias("f")).first().f
    assert (f.title, f.scripts, f.frameworks, f.forms) == ("A &amp; B", ["/jquery.js"], ["jquery"], ["/busca"])
    flags = [*W.FRAMEWORKS, *W.WALLS, *W.HINTS]
    marks = "react.js ng-app vue.js jquery-3 wp-content grecaptcha hCaptcha cf-chl Turnstile swagger-ui /v3/api-docs GraphQL '/api/v1/x'"
    g = spark.createDataFrame([(marks,)], "h string").select(W.fingerprint(F.col("h")).alias("f")).first().f
    assert [*g.frameworks, *g.walls, *g.hints] == [n for n, _ in flags] and g.api_paths == ["/api/v1/x"] and g.title is None
    files = spark.createDataFrame([(1, '{"html": "<tr><td>Edital</td><td>01/02/2024</td><td><a href=\\"/f.pdf\\">x</a></td></tr>"}'), (2, "no json")], "id int, p string")
    assert [tuple(r) for r in W.files_in_json(files, "p", ["id"]).collect()] == [(1, "Edital", "01/02/2024", "/f.pdf")]
    cards = spark.createDataFrame([(1, "x<section>Órgão: Prefeitura - Norte - Recife / PE<br>Número: 5/2024<br>")], "id int, h string")
    r = W.cards(cards, "h", "<section>", {"agency": "Órgão", "number": "Número"}, ["id"]).first()
    assert (r.agency, r.city, r.state, r.number) == ("Prefeitura - Norte", "Recife", "PE", "5/2024")


def test_contents_and_sinks(spark, tmp_path):
    for n, data in (("a.bin", b"one"), ("b.bin", b"one"), ("c.bin", b"two")):
        (tmp_path / n).write_bytes(data)
    at = datetime(2024, 1, 1)
    store = spark.createDataFrame([], "sha256 string, bytes long, content binary")
    links = spark.createDataFrame([], "source string, entity string, key string, sha256 string, first_seen timestamp, last_seen timestamp")
    new, linked = C.content_store(spark, str(tmp_path), store, links, "s", "doc", at)
    assert new.count() == 2 and linked.count() == 3 and C.verify_store(new).count() == 0
    again, _ = C.content_store(spark, str(tmp_path), new, linked, "s", "doc", at)
    assert again.count() == 0
    out = str(tmp_path / "months")
    C.materialize_monthly(spark.createDataFrame([("2024-01", 1), ("2024-02", 2)], "month string, n int"), out)
    C.materialize_monthly(spark.createDataFrame([("2024-02", 9)], "month string, n int"), out)
    assert sorted((r.month, r.n) for r in spark.read.parquet(out).collect()) == [("2024-01", 1), ("2024-02", 9)]


def test_replay_is_incremental(spark):
    raw = spark.createDataFrame(
        [("u1", '{"numeroControlePNCP": "k", "anoCompra": 1}'), ("u1", '{"numeroControlePNCP": "k", "anoCompra": 1}'), ("u2", '{"numeroControlePNCP": "m"}')],
        "url string, payload string"
    )
    landed = C.land_raw(raw.limit(0).withColumn("sha256", F.lit("")), raw, datetime(2024, 1, 1))
    assert landed.count() == 2 and C.land_raw(landed, raw, datetime(2024, 1, 2)).count() == 0
    assert C.replay(landed, N.normalize_tenders, ["key"]).count() == 2
