"""Issues, coverage, gaps, domains and threshold alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The federative units.
STATES = ("AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI", "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO")


def issues(df: DataFrame, entity: str, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """``entity, key, field, problem, value`` for every rule that a row breaks; rows stay where they are.

    ``rules``: problem to (field, condition of being broken); an unknown condition
    is not broken.
    """
    made = [
        F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem"), F.col(field).cast("string").alias("value")))
        for problem, (field, bad) in rules.items()
    ]
    return df.select(
        F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("i")
    ).select("entity", "key", "i.*")


def coverage_mismatch(files: DataFrame, least: float = 0.98) -> DataFrame:
    """Files of which too little was processed: ``file, expected, processed, errors`` or ``bytes_done, size``."""
    lines = (F.col("processed") + F.col("errors")) < F.col("expected") * least
    short = lines | (F.col("bytes_done") < F.col("size")) if {"bytes_done", "size"} <= set(files.columns) else lines
    return files.withColumn("mismatch", F.coalesce(short, F.lit(False)))


def gaps(matrix: DataFrame) -> DataFrame:
    """Years with months that are open."""
    return matrix.where(F.col("open") > 0).select("year", "open")


def out_of_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside a list, with counts; null is in every domain."""
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; nulls are equal to each other."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def level(pct: Column, limits: list[int]) -> Column:
    """The highest limit that is reached, else 0."""
    out = F.lit(0)
    for limit in sorted(limits):
        out = F.when(pct >= limit, limit).otherwise(out)
    return out


def threshold_alerts(series: DataFrame, keys: list[str], order: list[str], pct: str, limits: tuple[int, ...] = (70, 80, 90)) -> DataFrame:
    """Readings whose level differs from the last level that was reported; level 0 reports nothing and forgets nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = series.withColumn("level", level(F.col(pct), list(limits))).where(F.col("level") > 0)
    return at.withColumn("last_level", F.lag("level").over(w)).where(~F.col("level").eqNullSafe(F.col("last_level")))


def source_status(runs: DataFrame, source: str, rows: str, errors: str, ended: str) -> DataFrame:
    """``TEMPORARILY_UNAVAILABLE`` where the last run had errors and no rows, else ``ACTIVE``; with the last success."""
    last = runs.groupBy(source).agg(
        F.max_by(F.struct(F.col(rows).alias("r"), F.col(errors).alias("e")), F.col(ended)).alias("x"),
        F.max(F.when(F.col(errors) == 0, F.col(ended))).alias("last_success")
    )
    return last.select(source, F.when((F.col("x.e") > 0) & (F.col("x.r") == 0), "TEMPORARILY_UNAVAILABLE").otherwise("ACTIVE").alias("status"), "last_success")


def heal_documents(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Documents that are not JSON objects become objects of the counters in ``keep``."""
    healthy = F.coalesce(F.col(column).rlike(r"^\s*\{"), F.lit(False))
    return df.withColumn(column, F.when(healthy, F.col(column)).otherwise(F.to_json(F.struct(*keep))))
