"""Where intermediate tables go, and how they get there.

Executors may vanish at any time and do not see each other's disks, so whatever
has to outlive a job is written as Parquet to the folder named by
``spark.checkpoint.dir``, which all of them share.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tendril-")
        spark.sparkContext.setCheckpointDir(folder)
    return qualified(spark, folder)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, so that whoever opens it, Spark or a library in a task, takes the same file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = str(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)).rstrip("/")
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a qualified folder, for tasks."""
    return pafs.FileSystem.from_uri(folder)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one operator: ``clear`` removes them once what is kept of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        return self._write(df, shared_path(self.spark, name), by)

    def stored(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        return self._write(df, self.paths[-1], by)

    def _write(self, df: DataFrame, path: str, by: str | None) -> DataFrame:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


def written_order() -> list[Column]:
    """The place of a row of a table read from files: the partition that wrote it, its file of that partition, its row there."""
    name = F.col("_metadata.file_name")
    return [F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in the batches that go to Python, where texts may be long; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows or int(spark.conf.get(name, "10000")) <= 0:
        spark.conf.set(name, rows)


#: Rows that a side has at most where it is broadcast after a count.
SMALL = 200_000
#: A class with more than this part of all rows, and a thousand, is sent to every task; there are no more than this many.
HOT = 100_000


def dealt(rows: DataFrame, sizes: DataFrame, keys: list[str], ident: str, size: int) -> DataFrame:
    """``rows`` with ``cell`` and ``half``: every two rows of equal ``keys`` meet in exactly one cell.

    ``sizes`` has the rows of each group as ``_n``.  A group of up to ``size`` rows is
    cell 0.  A larger one is cut into parts by the hash of ``ident``; a cell holds
    one part, or two (``half`` 0 and 1), and pairs within a part are taken where it
    is alone.
    """
    large = stored(sizes.where(F.col("_n") > size), "large")
    known = rows.join(F.broadcast(large) if large.count() <= SMALL else large, keys, "left")
    parted = known.withColumn("_parts", F.coalesce(F.ceil(F.col("_n") / size), F.lit(1)).cast("long"))
    parted = parted.withColumn("_part", F.pmod(F.xxhash64(ident), F.col("_parts")))
    parted = parted.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    low, high = F.least(F.col("_part"), F.col("_other")), F.greatest(F.col("_part"), F.col("_other"))
    return parted.withColumns({"cell": low * F.col("_parts") + high, "half": F.when(F.col("_part") > F.col("_other"), 1).otherwise(0)}).drop("_n", "_parts", "_part", "_other")


def classed(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` left joined with ``classes``, a written table with a row for each of ``keys`` and its number of rows as ``count``.

    A class of very many rows would go to one task.  Such classes are few, as their
    counts add up to ``total`` at most: they are broadcast, and their rows stay where
    they are.
    """
    least = max(1000, total // HOT)
    hot, rest = classes.where(F.col(count) > least).drop(count), classes.where(F.col(count) <= least).drop(count)
    found = rows.join(F.broadcast(hot), keys)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys, "left")
    return others.unionByName(found)
