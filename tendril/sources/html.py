"""Tables, forms, cards and links out of HTML columns, by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.parse import json_kind
from tendril.functions.text import decode_entities


def strip_tags(s: Column) -> Column:
    return F.trim(F.regexp_replace(decode_entities(F.regexp_replace(s, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def _all(s: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(group))


def listing_rows(df: DataFrame, html: str, names: list[str], keep: list[str]) -> DataFrame:
    """Rows of HTML tables with a cell for each of ``names``; rows of other lengths are left out."""
    rows = df.select(*keep, F.posexplode(_all(F.col(html), r"(?s)<tr[^>]*>(.*?)</tr>")).alias("row", "_tr"))
    cells = rows.withColumn("_td", F.transform(_all(F.col("_tr"), r"(?s)<td[^>]*>(.*?)</td>"), strip_tags)).where(F.size("_td") == len(names))
    return cells.select(*keep, "row", *[F.col("_td")[k].alias(n) for k, n in enumerate(names)])


def form_fields(html: Column, ids: list[str]) -> list[Column]:
    """The ``value`` of inputs by ``id``; null where there is none."""
    return [F.nullif(decode_entities(F.regexp_extract(html, rf'(?s)id="{i}"[^>]*?value="([^"]*)"', 1)), F.lit("")).alias(i) for i in ids]


def files_in_json(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """(title, created, url) rows of the table in a JSON payload's ``html``; payloads that are no JSON give none."""
    rows = df.select(*keep, F.explode(_all(F.get_json_object(payload, "$.html"), r"(?s)<tr[^>]*>(.*?)</tr>")).alias("_tr"))
    cells = F.transform(_all(F.col("_tr"), r"(?s)<td[^>]*>(.*?)</td>"), strip_tags)
    url = F.nullif(F.regexp_extract("_tr", r'href="([^"]+)"', 1), F.lit(""))
    return rows.select(*keep, cells[0].alias("title"), F.get(cells, F.lit(1)).alias("created"), url.alias("url")).where(F.col("url").isNotNull())


def cards(df: DataFrame, html: str, marker: str, labels: dict[str, str], keep: list[str]) -> DataFrame:
    """Sections that begin with ``marker``, with the text after each label.

    ``labels``: column to label.  Agency and place are split at the last " - ", city
    and state at the last " / ", where a column ``agency`` is asked for.
    """
    parts = df.select(*keep, F.posexplode(F.slice(F.split(F.col(html), marker), 2, 1 << 30)).alias("card", "_part"))
    text = {c: F.nullif(strip_tags(F.regexp_extract("_part", rf"(?s){label}\s*:?\s*(?:</[^>]+>\s*<[^>]+>)?([^<]*)", 1)), F.lit("")) for c, label in labels.items()}
    out = parts.select(*keep, "card", *[v.alias(c) for c, v in text.items()])
    if "agency" not in labels:
        return out
    place = F.when(F.col("agency").contains(" - "), F.substring_index("agency", " - ", -1))
    name = F.when(place.isNotNull(), F.expr("substring(agency, 1, length(agency) - length(substring_index(agency, ' - ', -1)) - 3)")).otherwise(F.col("agency"))
    return out.withColumns({"_place": place, "_name": name}).withColumns(
        {
            "city": F.trim(F.substring_index("_place", " / ", 1)),
            "state": F.when(F.col("_place").contains(" / "), F.trim(F.substring_index("_place", " / ", -1))), "agency": F.trim("_name")
        }
    ).drop("_place", "_name")


def links(html: Column, extensions: str = "zip|csv|xlsx|xls|json|pdf") -> Column:
    """All addresses, those of folders and of files, and the earliest and latest year that they name."""
    hrefs = F.array_distinct(_all(html, r'href="([^"]+)"'))
    years = F.transform(F.flatten(F.transform(hrefs, lambda h: _all(h, r"((?:19|20)\d{2})"))), lambda y: y.cast("int"))
    return F.struct(
        hrefs.alias("hrefs"), F.filter(hrefs, lambda h: h.endswith("/")).alias("folders"),
        F.filter(hrefs, lambda h: F.lower(h).rlike(rf"\.({extensions})$")).alias("files"), F.array_min(years).alias("first_year"),
        F.array_max(years).alias("last_year")
    )


#: Fixed values: (flag, pattern) of frameworks, of anti-bot walls and of interfaces; whatever the case.
FRAMEWORKS = (
    ("react", r"react(-dom)?[.\-@]|data-reactroot|__NEXT_DATA__"),
    ("angular", r"ng-app|ng-version|angular\.js|zone\.js"),
    ("vue", r"vue\.js|__NUXT__|v-app"),
    ("jquery", r"jquery[.\-]"),
    ("wordpress", r"wp-content|wp-includes"),
)
WALLS = (
    ("recaptcha", r"recaptcha|grecaptcha"),
    ("hcaptcha", r"hcaptcha"),
    ("cloudflare_challenge", r"cf-chl|cf_chl|challenges\.cloudflare\.com|__cf_bm"),
    ("turnstile", r"turnstile"),
)
HINTS = (
    ("swagger_ui", r"swagger-ui|swagger\.json|swagger\.io"),
    ("openapi", r"openapi\.json|/v3/api-docs"),
    ("graphql", r"graphql"),
    ("api_path_ref", r"""["'](/api/[a-z0-9_\-/]+)["']"""),
)


def fingerprint(html: Column) -> Column:
    """Title, scripts, frameworks, walls, interface hints, API paths and form actions of a page."""
    flags = lambda table: F.array_compact(F.array(*[F.when(html.rlike(f"(?i){p}"), F.lit(n)) for n, p in table]))
    title = F.trim(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]{1,200})</title>", 1))
    return F.struct(
        F.when(html.rlike(r"(?i)<title[^>]*>[^<]{1,200}</title>"), title).alias("title"),
        F.slice(_all(html, r"""(?i)<script[^>]+src=["']([^"']+)["']"""), 1, 10).alias("scripts"),
        flags(FRAMEWORKS).alias("frameworks"),
        flags(WALLS).alias("walls"),
        flags(HINTS).alias("hints"),
        F.slice(F.array_distinct(_all(html, r"""["'](/?api/[a-zA-Z0-9_\-/]{2,60})["']""")), 1, 20).alias("api_paths"),
        F.slice(_all(html, r"""(?i)<form[^>]*action=["']([^"']*)["']"""), 1, 10).alias("forms"),
    )


#: Keys that the skeleton of an object shows, levels at which objects are opened, and lists within lists that are.
SHAPE_KEYS, SHAPE_DEPTH, LIST_DEPTH = 34, 3, 5


def json_shape(payload: Column) -> Column:
    """The skeleton of a JSON document: the first 34 keys of an object, ``array:n`` and the skeleton of its first element
    for a list, else the kind of value, which for null is ``object``; null if it is no JSON.

    Objects below three levels are ``object``; lists are opened down to five levels, and counted below.
    """

    def shape(s: Column, depth: int) -> Column:
        kind = json_kind(s)
        keys = F.concat(F.lit("{"), F.array_join(F.slice(F.json_object_keys(s), 1, SHAPE_KEYS), ","), F.lit("}")) if depth < SHAPE_DEPTH else F.lit("object")
        n = F.coalesce(F.json_array_length(s), F.lit(0))
        count = F.concat(F.lit("array:"), n)
        if depth < LIST_DEPTH:
            # a text among the elements comes without its quotes, a null not at all
            first = F.get_json_object(s, "$[0]")
            inner = F.coalesce(shape(first, depth + 1), F.when(first.isNull(), "object").otherwise("string"))
            count = F.when(n == 0, count).otherwise(F.concat(count, F.lit("["), inner, F.lit("]")))
        return F.when(kind == "object", keys).when(kind == "array", count).when(kind == "null", F.lit("object")).otherwise(kind)

    return shape(payload, 0)


def keyword_context(df: DataFrame, text: str, term: str, keep: list[str], before: int = 200, after: int = 600, most: int = 15) -> DataFrame:
    """Each occurrence of ``term`` with the characters around it, ``most`` of a text at most (a limit of this report)."""
    parts = F.split(F.col(text), rf"(?i)\Q{term}\E")
    n = F.least(F.size(parts) - 1, F.lit(most))
    pieces = df.where(F.lower(F.col(text)).contains(term.lower())).select(*keep, parts.alias("_p"), F.explode(F.sequence(F.lit(1), n)).alias("occurrence"))
    left, right = F.col("_p")[F.col("occurrence") - 1], F.col("_p")[F.col("occurrence")]
    return pieces.select(*keep, "occurrence", F.right(left, F.lit(before)).alias("before"), F.left(right, F.lit(after)).alias("after"))
