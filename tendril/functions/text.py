"""Accent-insensitive text: folding, slugs, and the all-words match rule."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from their Unicode decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0].lower()) for a, b in pairs if len(b) > 1 and b[0].isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _BASE = _folding()
# fixed values: letters that the dictionary flavour spells out
_SPELLED = (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("ø", "o"), ("ł", "l"), ("đ", "d"), ("ð", "d"), ("þ", "th"), ("ħ", "h"), ("ı", "i"), ("ŧ", "t"))
# fixed values: named entities that are decoded
_ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"),
    ("&oacute;", "ó"), ("&uacute;", "ú"), ("&atilde;", "ã"), ("&otilde;", "õ"), ("&ccedil;", "ç"), ("&acirc;", "â"), ("&ecirc;", "ê"),
    ("&ocirc;", "ô"), ("&agrave;", "à"), ("&amp;", "&")
)


def fold_accents(s: Column, dictionary: bool = False) -> Column:
    """Lower case without accents; null is ''.  ``dictionary`` also spells out letters such as ß."""
    out = F.translate(F.lower(F.coalesce(s, F.lit(""))), _ACCENTED, _BASE)
    if dictionary:
        for a, b in _SPELLED:
            out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(s: Column, separator: str = "-") -> Column:
    """Folded, with runs of anything but letters and digits as one separator, none at the ends."""
    runs = F.regexp_replace(fold_accents(s), "[^a-z0-9]+", separator)
    return F.regexp_replace(runs, f"^{separator}+|{separator}+$", "") if separator else runs


def term_words(term: Column) -> Column:
    """The folded words of more than one character."""
    return F.filter(F.split(fold_accents(term, True), r"\s+"), lambda w: F.length(w) > 1)


def _pattern(word: Column) -> Column:
    return F.concat(F.lit("%"), F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("%"))


def _like_anywhere(text: Column, word: Column) -> Column:
    return F.call_function("like", text, _pattern(word))


def wildcard_words(terms: Column) -> Column:
    """For each term its words, each with its LIKE pattern and whether it has wildcards; terms without words are dropped."""
    word = lambda w: F.struct(w.alias("word"), _pattern(w).alias("pattern"), w.rlike("[%_]").alias("wild"))
    return F.filter(F.transform(terms, lambda t: F.transform(term_words(t), word)), lambda t: F.size(t) > 0)


def folded_matches(folded: Column, terms: Column) -> Column:
    """Whether some term has all its words in the text, which is folded already: fold once for many rules."""
    ok = lambda t: (F.size(term_words(t)) > 0) & F.forall(term_words(t), lambda w: _like_anywhere(folded, w))
    return F.coalesce(F.exists(terms, ok), F.lit(False))


def text_matches(text: Column, terms: Column) -> Column:
    """Whether some term has all its words of more than one character in ``text``, in any order.

    Text and terms are folded by the dictionary flavour.  Words count as substrings,
    and ``%`` and ``_`` in them as wildcards.  No terms, a null text and terms
    without such words do not match.
    """
    return text.isNotNull() & folded_matches(fold_accents(text, True), terms)


def text_matches_phrase(text: Column, terms: Column) -> Column:
    """The older rule: some term stands in the text as written, whatever the case."""
    return F.coalesce(F.exists(terms, lambda t: _like_anywhere(F.lower(text), F.lower(t))), F.lit(False))


def effective_terms(include: Column, approved: Column) -> Column:
    """Distinct terms of a rule and its approved expansions that have more than one character."""
    every = F.array_union(F.coalesce(include, F.array().cast("array<string>")), F.coalesce(approved, F.array().cast("array<string>")))
    return F.filter(every, lambda t: F.length(F.trim(t)) > 1)


def decode_entities(s: Column) -> Column:
    """Decimal entities of any character and a fixed set of named ones; ``&amp;`` last; what is no character stays."""
    numeric = F.regexp_extract_all(s, F.lit(r"&#(\d{1,7});"), F.lit(1))
    point = lambda n: n.cast("int")
    real = lambda n: (point(n) > 0) & (point(n) <= 0x10FFFF) & ~point(n).between(0xD800, 0xDFFF)
    character = lambda n: F.decode(F.unhex(F.lpad(F.hex(point(n)), 8, "0")), "UTF-32")
    out = F.aggregate(F.filter(F.array_distinct(numeric), real), s, lambda acc, n: F.replace(acc, F.concat(F.lit("&#"), n, F.lit(";")), character(n)))
    for a, b in _ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def city_state(s: Column) -> tuple[Column, Column]:
    """City before the first dash and state after the last; without a dash the state is the whole."""
    return F.trim(F.split_part(s, F.lit("-"), F.lit(1))), F.nullif(F.trim(F.regexp_replace(s, "^.*-", "")), F.lit(""))


def label80(s: Column) -> Column:
    return F.lower(F.left(F.trim(s), F.lit(80)))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def process_key(agency_code: Column, modality: Column, number: Column) -> Column:
    """``agency:folded modality (12 characters):number``."""
    return F.concat_ws(":", agency_code, F.left(slug(modality, ""), F.lit(12)), number)


def register_functions(spark) -> None:
    """``fold_text``, ``text_ok`` and ``effective_terms`` as SQL functions of the session, by SQL expressions, not by Python."""
    fold = f"translate(lower(coalesce({{}}, '')), '{_ACCENTED}', '{_BASE}')"
    for a, b in _SPELLED:
        fold = f"replace({fold}, '{a}', '{b}')"
    words = f"filter(split({fold.format('t')}, '\\\\s+'), w -> length(w) > 1)"
    like = "s LIKE concat('%', replace(w, '\\\\', '\\\\\\\\'), '%')".replace("s LIKE", f"{fold.format('s')} LIKE")
    ok = f"s IS NOT NULL AND coalesce(exists(terms, t -> size({words}) > 0 AND forall({words}, w -> {like})), false)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fold_text(s STRING) RETURNS STRING RETURN {fold.format('s')}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_ok(s STRING, terms ARRAY<STRING>) RETURNS BOOLEAN RETURN {ok}")
    none = "cast(array() AS array<string>)"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION effective_terms(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN filter(array_union(coalesce(a, {none}), coalesce(b, {none})), t -> length(trim(t)) > 1)"
    )
