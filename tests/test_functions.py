"""Text, numbers, dates and documents."""

import pytest
from pyspark.sql import functions as F

from tendril.functions import parse as P
from tendril.functions import text as T


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'string' if not isinstance(v, tuple) else v[1]}" for k, v in values.items())
    row = tuple(v[0] if isinstance(v, tuple) else v for v in values.values())
    return spark.createDataFrame([row], kinds).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,plain,spelled", [("Ação ÚNICA", "acao unica", "acao unica"), ("Straße œuvre", "straße œuvre", "strasse oeuvre"), (None, "", "")])
def test_fold(spark, text, plain, spelled):
    assert one(spark, T.fold_accents(F.col("s")), s=text) == plain
    assert one(spark, T.fold_accents(F.col("s"), True), s=text) == spelled


@pytest.mark.parametrize(
    "text,terms,hit",
    [
        ("Energia elétrica", ["energia solar"], False),  # all words are needed
        ("energia SOLAR fotovoltaica", ["solár energia"], True),
        ("abc", ["a b"], False),  # only words of one character
        ("abc", [], False),
        (None, ["abc"], False),
        ("50 litros", ["5% lit"], True),  # a wildcard in the word
        ("a_b", ["a\\b"], False),
        ("limpeza", ["x", "limp"], True),
    ],
)
def test_text_matches(spark, text, terms, hit):
    assert one(spark, T.text_matches(F.col("s"), F.col("t")), s=text, t=(terms, "array<string>")) is hit


def test_terms_slug_entities(spark):
    assert one(spark, T.effective_terms(F.col("a"), F.col("b")), a=(["um", "x", "um"], "array<string>"), b=([" ", "dois"], "array<string>")) == ["um", "dois"]
    assert one(spark, T.effective_terms(F.col("a"), F.col("b")), a=(None, "array<string>"), b=(None, "array<string>")) == []
    assert one(spark, T.slug(F.col("s"), "_"), s="  Ano do Procésso / X ") == "ano_do_processo_x"
    assert one(spark, T.slug(F.col("s")), s="--a..B--") == "a-b"
    assert one(spark, T.decode_entities(F.col("s")), s="a&#231;&atilde;o &amp;lt; &nbsp;x&#999999;") == "ação &lt;  x\U000f423f"
    assert one(spark, T.decode_entities(F.col("s")), s="&#128512;&#9;&#55296;&#9999999;") == "\U0001f600\t&#55296;&#9999999;"
    city, state = T.city_state(F.col("s"))
    assert one(spark, city, s="São Luís-MA") == "São Luís" and one(spark, state, s="A-B-MA") == "MA" and one(spark, state, s="MA-") is None and one(spark, state, s="MA") == "MA"


@pytest.mark.parametrize("s,x", [("1.234,56", 1234.56), ("R$ 10", 10.0), ("12.5", 125.0), ("", None), (None, None), ("-3,5", -3.5), ("abc", None)])
def test_br_number(spark, s, x):
    assert one(spark, P.br_number(F.col("s")), s=s) == x


def test_number_or_null_never_makes_zero(spark):
    assert one(spark, P.number_or_null(F.col("s")), s="") is None
    assert one(spark, P.number_or_null(F.col("s")), s="12.5") == 12.5
    assert one(spark, P.number_or_null(F.col("s")), s="1.000,5") == 1000.5


@pytest.mark.parametrize("s,x", [("31/12/2024", "2024-12-31"), ("31/02/2024", None), ("1/2/2024", None), ("31/12/2024 10:00", None), (None, None)])
def test_br_date(spark, s, x):
    assert one(spark, P.br_date(F.col("s")).cast("string"), s=s) == x


def test_other_dates(spark):
    assert one(spark, P.br_or_iso_date(F.col("s")).cast("string"), s="2024-05-06T10:00") == "2024-05-06"
    assert one(spark, P.br_date_lenient(F.col("s")).cast("string"), s="06/05/2024 10:00") == "2024-05-06"
    assert one(spark, P.dotnet_date(F.col("s")).cast("string"), s="/Date(1700000000000)/").startswith("2023-11-14")
    assert one(spark, P.dotnet_date(F.col("s")), s="/Date(-1)/") is None
    assert one(spark, P.epoch_ms_label(F.col("n")), n=(0, "long")) == "" and one(spark, P.epoch_ms_label(F.col("n")), n=(1_700_000_000_000, "long")) == "14/11/2023"


@pytest.mark.parametrize(
    "s,ok",
    [("11.222.333/0001-81", True), ("11222333000181", True), ("11222333000180", False), ("11111111111111", False), ("12345678000190", False), ("1", False), (None, False)]
)
def test_cnpj(spark, s, ok):
    assert one(spark, P.valid_cnpj(F.col("s")), s=s) is ok


def test_supplier_phase_and_keys(spark):
    ident, name = P.supplier_from(F.col("s"))
    assert one(spark, ident, s="11.222.333/0001-81 - ACME LTDA") == "11222333000181" and one(spark, name, s="11.222.333/0001-81 - ACME LTDA") == "ACME LTDA"
    assert one(spark, P.expense_phase(F.col("s")), s="Pagamento") == "PAGAMENTO" and one(spark, P.expense_phase(F.col("s")), s="x") is None
    assert one(spark, P.is_official_id(F.col("s")), s="12345678000190-1-000001/2024") is True and one(spark, P.is_official_id(F.col("s")), s="1-1-1/2024") is False
    a, b = (one(spark, P.content_key([F.col("s"), F.col("t")], 24), s=x, t="y") for x in ("", None))
    assert a != b and len(a) == 24
    assert one(spark, P.money_label(F.col("v")), v=(1234567.0, "double")) == "R$ 1.234.567" and one(
        spark, P.money_label(F.col("v")), v=(None, "double")
    ) == "valor não informado" and one(spark, P.money_label(F.col("v")), v=(2.5, "double")) == "R$ 3"
    assert one(
        spark, P.url_extension(F.col("s"), F.col("t")), s="http://x/a.PDF?z=1", t="text/html"
    ) == "pdf" and one(spark, P.url_extension(F.col("s"), F.col("t")), s="http://x/a", t="x") == "bin"


def test_documents(spark):
    assert one(spark, P.json_object(F.col("s")), s='"{\\"a\\": 1}"') == {"a": "1"}
    assert one(spark, P.json_object(F.col("s")), s="[1]") is None
    m = "map<string,string>"
    assert one(spark, P.map_merge(F.col("a"), F.col("b")), a=({"x": "1", "y": "2"}, m), b=({"y": "3"}, m)) == {"x": "1", "y": "3"}
    assert one(spark, P.map_merge(F.col("a"), F.col("b")), a=(None, m), b=(None, m)) == {}
    assert one(spark, P.last_unique(F.col("a"), 2), a=(["a", "b", "a", "c"], "array<string>")) == ["b", "c"]
    assert one(spark, P.pct_change(F.col("a"), F.col("b")), a=(0.0, "double"), b=(5.0, "double")) is None
