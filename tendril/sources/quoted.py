"""Quoted files cut in parallel: many tasks a file, though fields may hold line ends.

Spark's text reader cuts files at line ends into splits, each read by one task.  Whether
a split begins inside quotes follows from the number of quotes before it: one pass sums
quotes, lines and bytes by split, the sums are added up along each file, and in a second
pass every task knows the state in which its split begins.  A record ends at a line end
outside quotes.  Records within a split are put together where they are read; of one that
goes on in the next split, or over many, only those pieces are grouped.

Every record has its file, the physical line and the byte at which it begins, so what is
refused can be found, and a load can go on from a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tendril.sources.delimited import CORRUPT

PIECES = "file string, line long, offset long, piece long, after long, text binary"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, value``: the lines of the files under ``path`` as bytes, by the split that each is read in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def split_starts(lines: DataFrame) -> DataFrame:
    """A row per split: ``file, block`` and the quotes, lines and bytes of its file before it."""
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value").cast("string"), F.lit('"'), F.lit("")))
    sums = lines.groupBy("file", "block").agg(F.sum(quotes).alias("q"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("b"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("q", "n", "b")])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the pieces of those that begin before or end after the split.

    A piece has the number of the line at which its record begins if that is in this
    split, else -1 and its own line; ``piece`` is null for whole records.
    """
    split, quotes, line, at = None, 0, 0, 0
    held: list[bytes] = []  # lines of the record that is open
    begun = (0, 0, False)  # where it begins, and whether before this split
    for batch in batches:
        out: list[tuple] = []
        files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values = batch.column(2).to_pylist()
        counts = pc.count_substring(batch.column(2), '"').to_pylist()
        for k, value in enumerate(values):
            if (files[k], blocks[k]) != split:
                out += _open(split, held, begun, at)
                split, held = (files[k], blocks[k]), []
                quotes, line, at = (batch.column(c)[k].as_py() for c in (3, 4, 5))
            if not held:
                begun = (line + 1, at, quotes % 2 == 1)
            held.append(value)
            quotes, line, at = quotes + counts[k], line + 1, at + len(value) + 1
            if quotes % 2 == 0:
                first, offset, cut = begun
                text = held[0] if len(held) == 1 else b"\n".join(held)
                out.append((split[0], -1 if cut else first, offset, first if cut else None, at, text))
                held = []
        if out:
            yield _batch(out)
    if rest := _open(split, held, begun, at):
        yield _batch(rest)


def _open(split, held: list[bytes], begun: tuple[int, int, bool], at: int) -> list[tuple]:
    """What is open where a split ends: a record's beginning, or the middle of one."""
    if not held:
        return []
    first, offset, cut = begun
    return [(split[0], -1 if cut else first, offset, first, at, b"\n".join(held))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in PIECES.split(", ")])


def logical_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, offset, after, text``: each record of the files, where it begins, the byte after it, and its bytes.

    Records that are blank are left out.  A quote that is never closed makes one record
    of the rest of its file, as for any reader of quoted fields.
    """
    lines = physical_lines(spark, path)
    starts = F.broadcast(split_starts(lines))  # a row for each split of some megabytes
    found = lines.join(starts, ["file", "block"]).select("file", "block", "value", "q0", "n0", "b0").mapInArrow(_pieces, PIECES)
    whole = found.where(F.col("piece").isNull()).select("file", "line", "offset", "after", "text")
    cut = found.where(F.col("piece").isNotNull())
    # pieces follow one another; a record begins at each that knows its line
    along = Window.partitionBy("file").orderBy("piece")
    cut = cut.withColumn("start", F.last(F.when(F.col("line") > 0, F.col("line")), ignorenulls=True).over(along))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.hex("text").alias("x")))), lambda p: p["x"]), "0A")
    joined = cut.groupBy("file", "start").agg(F.min("offset").alias("offset"), F.max("after").alias("after"), F.unhex(text).alias("text"))
    rows = whole.unionByName(joined.select("file", F.col("start").alias("line"), "offset", "after", "text"))
    return rows.where(F.length(F.btrim(F.col("text").cast("string"), F.lit(" \r\n\t"))) > 0)


def read_quoted(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1", after: DataFrame | None = None) -> DataFrame:
    """All columns as text under the names of the first record, with ``_corrupt_record, _file, _line, _offset, _after``.

    The files under ``path`` have the same header.  ``after`` (``file, offset``) names
    bytes up to which files have been loaded: only records that begin there or later
    are returned, and all of files that it does not name.  ``_after`` is the byte to go
    on from.  Lines that do not fit the header have ``_corrupt_record``.
    """
    rows = logical_records(spark, path).withColumn("text", F.rtrim(F.decode("text", encoding), F.lit("\r")))
    head = physical_lines(spark, path).where(F.length("value") > 0).select(F.decode("value", encoding).alias("v")).first()
    if head is None:
        return rows.select(
            F.lit(None).cast("string").alias(CORRUPT), F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("offset").alias("_offset"),
            F.col("after").alias("_after")
        ).limit(0)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "maxCharsPerColumn": "-1"}
    first = head[0].rstrip("\r").lstrip("﻿").removeprefix("ï»¿")
    names = spark.createDataFrame([(first,)], "v string").select(
        F.from_csv("v", F.schema_of_csv(first, {"sep": sep, "quote": '"', "escape": '"'}), {"sep": sep, "quote": '"', "escape": '"'}).alias("x")
    ).select("x.*").first()
    columns = [str(n).strip().replace("`", "") for n in names]
    schema = ", ".join(f"`{c}` string" for c in columns) + f", `{CORRUPT}` string"
    if after is not None:
        known = after.select(F.col("file").alias("_f"), F.col("offset").alias("_o"))
        rows = rows.join(known, F.col("file") == F.col("_f"), "left").where(F.col("_o").isNull() | (F.col("offset") >= F.col("_o"))).drop("_f", "_o")
    parsed = rows.where(F.col("line") > 1).withColumn("_x", F.from_csv("text", schema, options))
    return parsed.select("_x.*", F.col("file").alias("_file"), F.col("line").alias("_line"), F.col("offset").alias("_offset"), F.col("after").alias("_after"))


def loaded(rows: DataFrame) -> DataFrame:
    """``file, offset``: where the load of each file goes on after ``rows`` of ``read_quoted``."""
    return rows.groupBy(F.col("_file").alias("file")).agg(F.max("_after").alias("offset"))
