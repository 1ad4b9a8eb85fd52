"""Numbers, dates, identifiers and JSON documents as they come from Brazilian sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def br_number(s: Column) -> Column:
    """``1.234,56`` as 1234.56: all dots go, the first comma is the point; null if nothing is left.  ``12.5`` is 125."""
    plain = F.regexp_replace(F.replace(s, F.lit("."), F.lit("")), r"^([^,]*),", "$1.")
    return F.regexp_replace(plain, r"[^0-9.\-]", "").try_cast("double")


def number_or_null(s: Column) -> Column:
    """A plain number as it is, else as :func:`br_number`; blank and null are null, never zero."""
    return F.coalesce(F.trim(s).try_cast("double"), br_number(s))


def br_date(s: Column) -> Column:
    """``dd/mm/yyyy`` and nothing else; impossible dates are null."""
    return F.when(s.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_date(s, "dd/MM/yyyy"))


def iso_prefix(s: Column) -> Column:
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.left(s, F.lit(10)), "yyyy-MM-dd"))


def br_date_lenient(s: Column) -> Column:
    """A leading ``dd/mm/yyyy``, else a leading ISO date."""
    return F.coalesce(br_date(F.left(s, F.lit(10))), iso_prefix(s))


def br_or_iso_date(s: Column) -> Column:
    return F.coalesce(br_date(s), iso_prefix(s))


def epoch_ms_label(ms: Column) -> Column:
    """``dd/mm/yyyy`` of UTC milliseconds; null and 0 are ''."""
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("")).otherwise(F.date_format(F.timestamp_millis(ms), "dd/MM/yyyy"))


def dotnet_date(s: Column) -> Column:
    """The instant in ``/Date(ms)/``; null before 1970."""
    ms = F.nullif(F.regexp_extract(s, r"/Date\((-?\d+)", 1), F.lit("")).try_cast("long")
    return F.when(ms >= 0, F.timestamp_millis(ms))


def br_datetime_at(s: Column) -> Column:
    """``dd/mm/yyyy às hh:mm`` as a timestamp."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(s), r"\s*[àa]s\s*", " "), F.lit("dd/MM/yyyy HH:mm"))


def month_window(year: Column, month: Column) -> tuple[Column, Column]:
    """First and last day as ``yyyymmdd``."""
    first = F.make_date(year, month, F.lit(1))
    return F.date_format(first, "yyyyMMdd"), F.date_format(F.last_day(first), "yyyyMMdd")


def digits(s: Column) -> Column:
    return F.nullif(F.regexp_replace(s, r"\D", ""), F.lit(""))


def _check_digit(d: Column, weights: list[int]) -> Column:
    total = reduce(lambda a, b: a + b, [F.substring(d, k + 1, 1).try_cast("int") * w for k, w in enumerate(weights)])
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def valid_cnpj(s: Column) -> Column:
    """Fourteen digits, not all equal, with both check digits right; null is not valid."""
    d = F.coalesce(F.regexp_replace(s, r"\D", ""), F.lit(""))
    first, second = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    shaped = (F.length(d) == 14) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")
    return F.coalesce(shaped & (_check_digit(d, first) == F.substring(d, 13, 1).try_cast("int")) & (_check_digit(d, second) == F.substring(d, 14, 1).try_cast("int")), F.lit(False))


def supplier_from(value: Column) -> tuple[Column, Column]:
    """(id, name) from ``12.345.678/0001-90 - NAME`` or the like."""
    pattern = r"\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}"
    ident = digits(F.regexp_extract(value, pattern, 0))
    return ident, F.nullif(F.trim(F.regexp_replace(F.regexp_replace(value, pattern, ""), r"^[\s\-–:]+|[\s\-–:]+$", "")), F.lit(""))


def expense_phase(s: Column) -> Column:
    up = F.upper(s)
    return F.when(up.contains("EMPENHO"), "EMPENHO").when(up.contains("LIQUIDA"), "LIQUIDACAO").when(up.contains("PAGAMENTO"), "PAGAMENTO")


#: Fixed values: (part of the address, label), the first that is found counts.
URL_CONTEXTS = (("/contratacoes/", "contratacoes"), ("/resultados", "resultados"), ("/itens", "itens"), ("/arquivos", "arquivos"), ("/contratos", "contratos"))


def url_context(url: Column, contexts=URL_CONTEXTS, other: str = "outro") -> Column:
    out = F.lit(other)
    for part, label in reversed(contexts):
        out = F.when(F.coalesce(url, F.lit("")).contains(part), F.lit(label)).otherwise(out)
    return out


def url_extension(url: Column, content_type: Column) -> Column:
    """The address's extension, else pdf by content type, else bin."""
    found = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,5})(?:[?#].*)?$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.when(content_type.contains("pdf"), "pdf"), F.lit("bin"))


def is_official_id(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^\d{14}-\d-\d+/\d{4}$"), F.lit(False))


def content_key(columns: list[Column], n: int = 32) -> Column:
    """The first ``n`` hex digits of the SHA-256 of the columns as JSON; nulls are kept apart from blanks."""
    return F.left(F.sha2(F.to_json(F.array(*[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns])), 256), F.lit(n))


def money_label(v: Column) -> Column:
    """``R$ 1.234.567``; null says that there is no value."""
    return F.coalesce(F.concat(F.lit("R$ "), F.replace(F.format_number(F.round(v, 0), 0), F.lit(","), F.lit("."))), F.lit("valor não informado"))


def pct_change(old: Column, new: Column, places: int = 1) -> Column:
    """Per cent rounded half away from zero: multiplied first, so that 418.84999999999997, which is 418.85 but for its last bit, is 418.9."""
    unit = F.lit(10.0**places)
    return F.when(old > 0, F.round((new - old) / old * 100 * unit, 0) / unit + F.lit(0.0))  # no negative zero


def last_unique(values: Column, n: int = 500) -> Column:
    """The last ``n`` of the distinct values."""
    u = F.array_distinct(values)
    return F.slice(u, F.greatest(F.lit(1), F.size(u) - n + 1), n)


def map_merge(old: Column, new: Column) -> Column:
    """``new`` over ``old``; null documents are empty."""
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def json_object(s: Column) -> Column:
    """A JSON object's fields as text; anything else is an empty document.  Objects stored as JSON strings are unwrapped."""
    inner = repair_double_encoded(s)
    return F.when(inner.rlike(r"^\s*\{"), F.from_json(inner, "map<string,string>"))


def repair_double_encoded(s: Column) -> Column:
    """A JSON string that holds JSON, as that JSON."""
    return F.when(s.rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"x":'), s, F.lit("}")), "$.x")).otherwise(s)


def string_array(s: Column, default: Column | None = None) -> Column:
    """A JSON array of texts; ``default``, else an empty array, for null and for what is none."""
    return F.coalesce(F.from_json(s, "array<string>"), default if default is not None else F.array().cast("array<string>"))


def json_kind(s: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` of a JSON text; null if it is none."""
    kind = F.regexp_extract(F.schema_of_variant(F.try_parse_json(s)), "^[A-Z]+", 0)
    names = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    out = F.lit("number")
    for k, v in names.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return F.when(kind != "", out)


def without_key(document: Column, key: str) -> Column:
    """A document (map) without one of its fields."""
    return F.map_filter(document, lambda k, _: k != F.lit(key))
