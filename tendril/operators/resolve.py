"""Identity across sources: links by official id and by name and number, conflicts, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.functions.parse import is_official_id
from tendril.functions.text import fold_accents


def links_by_official_id(sources: dict[str, tuple[DataFrame, str, str]], prefix: str = "pncp") -> DataFrame:
    """``canonical_key, source, record_key`` for the records of each source that carry an official id.

    ``sources``: name to (df, record key, official id).
    """
    rows = None
    for name, (df, key, official) in sources.items():
        one = df.where(F.col(official).isNotNull()).select(
            F.concat_ws(":", F.lit(prefix), F.col(official).cast("string")).alias("canonical_key"), F.lit(name).alias("source"),
            F.col(key).cast("string").alias("record_key")
        ).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows


def value_conflicts(left: DataFrame, right: DataFrame, key: str, value: str, source: str, known: DataFrame | None = None, confidence: float = 0.6) -> DataFrame:
    """Entities for which both sides have a value and the values differ, unless recorded already; nothing is overwritten."""
    b = right.select(key, F.col(value).alias("_new"))
    found = left.select(key, F.col(value).alias("_old")).join(b, key).where(F.col("_old").isNotNull() & F.col("_new").isNotNull() & (F.col("_old") != F.col("_new")))
    out = found.select(
        key, F.lit(value).alias("field"), F.col("_old").alias("old_value"), F.col("_new").alias("new_value"), F.lit(source).alias("source"),
        F.lit(confidence).alias("confidence")
    )
    return out if known is None else out.join(known.select(key, "field", "source"), [key, "field", "source"], "left_anti")


def _whole_number(s: Column) -> Column:
    """The digits without leading zeros; any length, so compared as text."""
    return F.nullif(F.regexp_replace(s, "^0+(?=.)", ""), F.lit(""))


def purchase_number(s: Column) -> Column:
    """A number that is digits alone once trimmed."""
    return F.when(F.trim(s).rlike(r"^\d+$"), _whole_number(F.trim(s)))


def process_number(s: Column) -> Column:
    """All digits of a process number."""
    return _whole_number(F.nullif(F.regexp_replace(s, r"\D", ""), F.lit("")))


def agency_name(s: Column) -> Column:
    """Upper case without accents, with single spaces; null is ''."""
    return F.upper(fold_accents(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " ")), True))


def resolve_by_name_number(records: DataFrame, candidates: DataFrame, source: str, pending: DataFrame | None = None, with_agency: bool = False) -> tuple[DataFrame, DataFrame]:
    """Canonical keys for unlinked records: (links, reviews).

    ``records``: ``record_key, agency, number, city_uf``; ``candidates``:
    ``canonical_key, agency, purchase_no, process_no``.  The record's number is all of
    its digits.  A candidate has the same agency name, folded and with single spaces,
    and that number as its purchase number, if this is digits alone, or as the digits
    of its process number.  Candidates are gathered once a name and number, not once a
    record, so that pairs of records and candidates are never made.  No candidate: a new key
    ``proc:UF:CITY:number``, with ``XX`` and ``?`` for what is not known; one: its
    key; several: a review with all of them, one a record.  Without a name or a number the key is
    ``src:source:record``.  Records under review are passed over.
    """
    todo = records if pending is None else records.join(pending.select("record_key"), "record_key", "left_anti")
    place = F.coalesce("city_uf", F.lit(""))
    state = F.nullif(F.regexp_replace(place, "^.*-", ""), F.lit(""))
    city = F.nullif(F.upper(fold_accents(F.trim(F.split_part(place, F.lit("-"), F.lit(1))), True)), F.lit(""))
    todo = todo.withColumns({"_name": agency_name(F.col("agency")), "_number": process_number(F.col("number"))})
    named = candidates.select(
        "canonical_key", agency_name(F.col("agency")).alias("_name"), purchase_number(F.col("purchase_no")).alias("_purchase"),
        process_number(F.col("process_no")).alias("_process")
    )
    by = ["_name", "_asked"]
    todo = todo.withColumn("_asked", F.when((F.col("_name") != "") & F.col("record_key").isNotNull(), F.col("_number")))
    sides = [
        named.where(F.col(number).isNotNull() & (F.col("_name") != "")).select("canonical_key", "_name", F.col(number).alias("_asked"))
        for number in ("_purchase", "_process")
    ]
    groups = sides[0].unionByName(sides[1]).groupBy(*by).agg(F.array_sort(F.collect_set("canonical_key")).alias("candidates"))
    counted = lambda df: df.withColumns({"_n": F.size("candidates"), "_one": F.col("candidates")[0]})
    # a record that comes more than once has the candidates of all its rows
    again = todo.where(F.col("_asked").isNotNull()).groupBy("record_key").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1).select("record_key")
    several = todo.join(again, "record_key", "left_semi")
    found = several.select("record_key", *by).join(groups, by).groupBy("record_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidates")))).alias("candidates"))
    once = todo.join(again, "record_key", "left_anti").join(counted(groups), by, "left")
    all_ = once.unionByName(several.join(counted(found), "record_key", "left").select(once.columns))
    n = F.coalesce("_n", F.lit(0))
    parts = [F.lit("proc"), F.coalesce(state, F.lit("XX")), F.coalesce(city, F.lit("?")), F.col("_number")]
    if with_agency:
        parts.append(F.col("_name"))
    blank = (F.col("_name") == "") | F.col("_number").isNull()
    key = F.when(blank, F.concat_ws(":", F.lit("src"), F.lit(source), "record_key")).when(n == 0, F.concat_ws(":", *parts)).when(n == 1, F.col("_one"))
    how = F.when(blank, "source").when(n == 0, "new").when(n == 1, "linked").otherwise("review")
    links = all_.select("record_key", key.alias("canonical_key"), how.alias("how")).where(F.col("how") != "review")
    reviews = lambda df: df.where(~blank & (n > 1)).select("record_key", "candidates")
    return links, reviews(once).unionByName(reviews(several.join(counted(found), "record_key")).dropDuplicates(["record_key"]))


def queue_reviews(open_reviews: DataFrame, new: DataFrame, keys: list[str], once: bool = False) -> DataFrame:
    """Open reviews with the new ones whose keys have none open; ``once``: no two new ones have the same keys, so none is moved to find out."""
    return open_reviews.unionByName((new if once else new.dropDuplicates(keys)).join(open_reviews.where(~F.col("resolved")).select(*keys), keys, "left_anti"))


def canonical_by_document(df: DataFrame, dataset: str, document: str, key: str) -> DataFrame:
    """Sanctioned parties are known by the dataset and their document."""
    return df.where(F.col(document).isNotNull()).select(
        F.concat_ws(":", F.lit(dataset), F.col(document).cast("string")).alias("canonical_key"), F.col(key).cast("string").alias("record_key")
    ).distinct()


def mark_possible_duplicates(df: DataFrame, key: str) -> DataFrame:
    """The official id that a legacy key itself is, if it has that form."""
    return df.withColumn("possible_duplicate_of", F.when(is_official_id(F.col(key)), F.col(key)))


def merge_placeholders(registry: DataFrame, pairs: DataFrame, key: str, url: str, status: str) -> DataFrame:
    """Placeholders take over the address of their real source and are discontinued; ``pairs``: ``placeholder, real``."""
    real = registry.select(F.col(key).alias("real"), F.col(url).alias("_url"))
    todo = pairs.join(real, "real").select(F.col("placeholder").alias(key), "_url")
    joined = registry.join(todo, key, "left")
    there = F.col("_url").isNotNull()
    return joined.select(
        *[
            F.when(there, F.col("_url")).otherwise(F.col(c)).alias(c) if c == url else F.when(there, "DISCONTINUED").otherwise(F.col(c)).alias(c)
            if c == status else F.col(c) for c in registry.columns
        ]
    )
