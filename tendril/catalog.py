"""The registry of named queries and of the SQL that states the same results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Rows that one task of a shuffle takes, as counted before it.
ROWS_A_PART = 500_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder; a local one only where none is set and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tendril-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder: its lineage ends here."""
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the session's checkpoint folder: what reads it reads only the columns that it needs."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(rows: int) -> int:
    """How many tasks ``rows`` rows ask for."""
    return max(1, -(-rows // ROWS_A_PART))


@contextmanager
def roomy(spark: SparkSession, rows: int):
    """Jobs within shuffle into as many parts as so many rows ask for, none put together again, so a task's memory does not grow with the table.

    Where the session's own parts are enough it stays as it is.
    """
    parts, before = "spark.sql.shuffle.partitions", {}
    if parts_of(rows) > int(spark.conf.get(parts)):
        wanted = {parts: str(parts_of(rows)), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
        before = {n: spark.conf.get(n) for n in wanted}
        for n, v in wanted.items():
            spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
