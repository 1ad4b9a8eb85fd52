"""Line dedup by levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of
``least_chars`` or more code points that ``least_docs`` documents hold go everywhere
but in the largest ``doc_id`` that holds them.

Documents are taken in batches from the largest ids down.  What is known of keys lies
in *runs*: tables of (hash, documents, keeper) bucketed and sorted by hash, so that a
batch meets them by merge joins for which only the batch is shuffled.  A batch's keys
are first anti-joined with the keys that the runs have settled (``least_docs`` documents
or more, and a keeper that no smaller id can change); the rest is written as a run of
its own at level 0.  ``fan`` runs of a level are merged into one of the next.  When all
batches are in, the runs are merged into one, whose settled keys say which lines go.

A key is known by 96 hash bits: among 10^12 different lines the chance that any two
clash is about 6 in a million.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm.shared import Scratch, classed

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES, FAN = 4, 2
#: Fixed value: the white space that is stripped.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h", "g"]


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANKS))


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id, row, pos, h, g, first`` of every line that may repeat; ``row`` is a hash of the text, ``first`` says that the document holds the key no earlier."""
    keys = F.transform(text_lines(F.col("text")), line_key)
    long = F.filter(
        F.transform(keys, lambda x, k: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), k.alias("pos"), (F.length(x) >= least_chars).alias("ok"))),
        lambda x: x["ok"]
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row"), F.sort_array(long).alias("_s"))
    rows = rows.select("doc_id", "row", "_s", F.posexplode("_s").alias("_k", "_x"))
    before = F.get("_s", F.col("_k") - 1)
    again = F.coalesce((before["h"] == F.col("_x.h")) & (before["g"] == F.col("_x.g")), F.lit(False))
    return rows.select("doc_id", "row", "_x.pos", "_x.h", "_x.g", (~again).alias("first"))


class Runs:
    """Levelled runs of (``h, g, docs, keeper``), each a table bucketed and sorted by hash.

    Batches must come from larger ids to smaller ones, so that a keeper never changes.
    """

    def __init__(self, spark: SparkSession, least_docs: int = LEAST_DOCS, fan: int = FAN):
        self.spark, self.least_docs, self.fan = spark, least_docs, max(2, fan)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        keys.select(*KEY, "docs", "keeper").repartition(self.buckets, *KEY).write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)

    def _merge(self, names: list[str], level: int) -> None:
        parts = [self.spark.table(n) for n in names]
        both = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))
        self._write(both, level)
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def settled(self) -> list[DataFrame]:
        return [self.spark.table(n).where(F.col("docs") >= self.least_docs) for names in self.levels for n in names]

    def add(self, lines: DataFrame) -> None:
        """A batch of ``hashed_lines``: keys not settled yet become a run; full levels are merged into the next."""
        keys = lines.where("first").groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"))
        for run in self.settled():
            keys = keys.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        self._write(keys, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            names, self.levels[level] = self.levels[level], []
            self._merge(names, level + 1)
            level += 1

    def close(self) -> DataFrame:
        """One run of all, whose settled keys are returned: ``h, g, docs, keeper``."""
        names = [n for level in self.levels for n in level]
        self.levels = []
        if len(names) > 1:
            self._merge(names, 0)
        else:
            self.levels = [names]
        return self.settled()[0]

    def drop(self) -> None:
        for name in (n for level in self.levels for n in level):
            self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def repeated_lines(docs: DataFrame, scratch: Scratch, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """``doc_id, row, gone``: the places of the lines that go, ascending, for each document that loses any."""
    spark = docs.sparkSession
    share = [k / batches for k in range(1, batches)]
    bounds = (docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), share, 10_000)).first()[0] or []) if share else []
    batch = reduce(lambda a, b: a + b, [F.when(F.col("doc_id") <= b, 1).otherwise(0) for b in sorted(set(bounds))], F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    lines = scratch.stored(hashed_lines(docs, least_chars).withColumn("batch", batch), "lines", by="batch")
    runs = Runs(spark, least_docs, fan)
    for k in range(len(set(bounds)) + 2):
        runs.add(lines.where(F.col("batch") == k))
    found = runs.close()
    total = lines.count()
    counts = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    classes = scratch.stored(counts.join(found.select(*KEY, "keeper").hint("merge"), KEY), "repeated")
    gone = classed(lines.select("doc_id", "row", "pos", *KEY), classes, KEY, "n", total).where("keeper is not null and not (doc_id <=> keeper)")
    gone = scratch.kept(gone.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone")), "gone")
    runs.drop()
    return gone


def without_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every document with the lines that stay, joined by line ends.

    Rows are documents: rows of equal id each count, and all rows of the largest id
    keep its lines.  Null ids are smaller than all others; a key that only null ids
    hold stays.  A null or empty text has one empty line.  Blank and short lines
    always stay.  Only ``doc_id`` and ``text`` are read.  An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession)
    gone = repeated_lines(docs, scratch, least_chars, least_docs, batches, fan).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "gone")
    scratch.clear()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left")
    lines = text_lines(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    return rows.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped")
    )
