"""Delimited files: monthly and yearly sets, fuzzy headers, multi-line records, quarantine."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"


def fold_name(s: str) -> str:
    """Lower case without accents, for header names and file names: these are few and read by the driver."""
    return "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)).strip().lstrip("﻿")


def slug_name(s: str) -> str:
    return "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in fold_name(s)).split())


def map_header(headers: list[str], alternatives: list[list[str]]) -> int:
    """The place of the first header that holds all fragments of an alternative, the earliest alternative first; -1 if none."""
    names = [fold_name(h) for h in headers]
    for fragments in alternatives:
        for k, name in enumerate(names):
            if all(f in name for f in fragments):
                return k
    return -1


def header_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The first line of a file or of the first file of a folder."""
    rows = spark.read.option("encoding", encoding).option("header", False).option("sep", "\u0001").option("quote", "").csv(path).limit(1).collect()
    return (rows[0][0] or "").lstrip("﻿") if rows else ""


def sniff_separator(line: str) -> str:
    return ";" if line.count(";") >= line.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """All columns as text under their own names; quoted fields may hold line ends, doubled quotes are quotes.

    Lines that do not fit the header come out in ``_corrupt_record``.
    """
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    names = reader.csv(path).columns
    schema = ", ".join(f"`{n.lstrip(chr(0xFEFF)).replace('`', '')}` string" for n in names if n != CORRUPT) + f", `{CORRUPT}` string"
    return reader.schema(schema).csv(path)


def read_mapped(spark: SparkSession, path: str, columns: dict[str, list[list[str]]], key: str, encoding: str = "UTF-8") -> DataFrame:
    """A file of unknown header as logical columns: separator from the header, columns by fragments of their names.

    ``columns``: logical name to alternatives of fragments.  Columns that are not
    found are null; a file without the key column is refused.
    """
    line = header_line(spark, path, encoding)
    df = read_delimited(spark, path, sniff_separator(line), encoding)
    headers = [c for c in df.columns if c != CORRUPT]
    place = {name: map_header(headers, alternatives) for name, alternatives in columns.items()}
    if place[key] < 0:
        raise ValueError(f"no column for {key} in {headers}")
    return df.select(*[F.col(f"`{headers[k]}`").alias(n) if k >= 0 else F.lit(None).cast("string").alias(n) for n, k in place.items()], CORRUPT)


#: What a monthly file holds, by a fragment of its name.
ROLES = {"tenders": "licitacao", "items": "itemlicitacao", "bidders": "participanteslicitacao", "commitments": "empenhosrelacionados"}


def file_role(name: str) -> str | None:
    """The longest fragment that the name holds decides."""
    base = fold_name(name).replace("_", "").replace(" ", "").replace("ç", "c")
    found = [(len(f), role) for role, f in ROLES.items() if f in base]
    return max(found)[1] if found else None


def read_period(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The tables of one month by role, from file paths; files of no role are passed over."""
    by_role: dict[str, list[str]] = {}
    for p in paths:
        if role := file_role(p.rsplit("/", 1)[-1]):
            by_role.setdefault(role, []).append(p)
    return {role: read_delimited(spark, files if len(files) > 1 else files[0]) for role, files in by_role.items()}


def read_passthrough(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", sep: str = ";") -> DataFrame:
    """Every column under its slugged name, and the row as a map in ``data``."""
    df = read_delimited(spark, path, sep, encoding).drop(CORRUPT)
    df = df.toDF(*[slug_name(c) for c in df.columns])
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(c))]
    return df.withColumn("data", F.create_map(*pairs))


#: Where a record was found; columns that the readers add and that are no part of its content.
PLACE = ("_file", "_line", "_offset", "_after")


def numbered(df: DataFrame) -> DataFrame:
    """Rows of files that quoted line ends keep whole, with ``_file`` and ``_line``, the record's place in it.

    Such a file is read by one task, in order, so the running numbers of its rows follow one
    another, and the first one of each file is taken off: nothing is sorted.
    :mod:`tendril.sources.quoted` reads a file by many tasks and tells its lines and bytes.
    """
    rows = df.withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    first = rows.groupBy("_file").agg(F.min("_at").alias("_first"))  # a row a file
    return rows.join(F.broadcast(first), "_file").withColumn("_line", F.col("_at") - F.col("_first") + 1).select(*df.columns, "_file", "_line")


def quarantine(df: DataFrame, required: list[str], most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(good rows, ``file, line, error, content``): rows that did not parse or lack a required column never stop a load.

    ``file`` and ``line`` are those of the columns ``_file`` and ``_line`` where a reader
    has added them (``numbered``, ``read_quoted``), else the file that is read and null.
    """
    corrupt = F.col(CORRUPT) if CORRUPT in df.columns else F.lit(None).cast("string")
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(c)) for c in required]))
    error = F.when(corrupt.isNotNull(), F.lit("malformed")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    own = [c for c in df.columns if c != CORRUPT and c not in PLACE]
    file = F.col("_file") if "_file" in df.columns else F.input_file_name()
    line = F.col("_line") if "_line" in df.columns else F.lit(None).cast("long")
    content = F.left(F.coalesce(corrupt, F.to_json(F.struct(*own))), F.lit(most))
    marked = df.select("*", error.alias("_error"), file.alias("_from"), line.alias("_at"), content.alias("_content"))
    bad = marked.where(F.col("_error").isNotNull()).select(
        F.col("_from").alias("file"), F.col("_at").alias("line"), F.col("_error").alias("error"), F.col("_content").alias("content")
    )
    return marked.where(F.col("_error").isNull()).select(*own), bad
