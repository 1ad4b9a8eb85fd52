"""Raw payloads and binaries by content hash, replay, manifests, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.operators.history import first_per_key, upsert
from tendril.streaming.buckets import BucketTable

#: Tasks that write one month.
WRITERS = 8


def land_raw(current: DataFrame, batch: DataFrame, collected_at) -> DataFrame:
    """New raw rows only: payloads whose (url, SHA-256) is not there yet, once each.

    ``batch``: ``url, payload``; the result is to be appended to ``current``.
    """
    hashed = batch.withColumn("sha256", F.sha2("payload", 256)).dropDuplicates(["url", "sha256"])
    return hashed.join(current.select("url", "sha256"), ["url", "sha256"], "left_anti").withColumn("collected_at", F.lit(collected_at))


def replay(raw: DataFrame, normalizer: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """The normalised table rebuilt from all raw rows, the latest of each key."""
    rows = normalizer(raw)
    return first_per_key(rows, keys, [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys])


def content_dedup(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row per distinct content: hash, the smallest key, and the number of rows that refer to it."""
    return df.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(key).alias("first_key"), F.count("*").alias("refs"))


def content_store(spark: SparkSession, path: str, store: DataFrame, links: DataFrame, source: str, entity: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Files under ``path`` into (new contents, links): bytes once for each hash, a link for each file, the last one wins."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        F.col("path").alias("key"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content"
    )
    new = files.dropDuplicates(["sha256"]).join(store.select("sha256"), "sha256", "left_anti").select("sha256", "bytes", "content")
    batch = files.select(F.lit(source).alias("source"), F.lit(entity).alias("entity"), "key", "sha256")
    return new, upsert(links, batch, ["source", "entity", "key"], as_of)


class ContentStore:
    """Contents by hash under ``folder``: bytes once for each hash, links last-wins.

    Hashes and links are tables in buckets, of which a batch reads and writes those that
    its hashes and keys fall into; of hashes that are there only the bucket's hashes are
    read.  Contents stay where they are until it is known which are new: hashes and keys
    are made distinct and compared, and contents are fetched for new ones only and
    appended under the batch's version.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder = spark, folder
        self.hashes = BucketTable(spark, f"{folder}/hashes", ["sha256"], "sha256 string, bytes long, version long", buckets)
        self.links = BucketTable(spark, f"{folder}/links", ["key"], "key string, sha256 string, first_seen timestamp, last_seen timestamp", buckets)

    def put(self, batch: DataFrame, as_of, version: int) -> None:
        """``batch``: ``key, content`` (text or bytes); of rows with equal keys the one with the largest hash counts."""
        raw = F.col("content").cast("binary")
        named = batch.select(F.col("key").cast("string").alias("key"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("bytes"))
        latest = named.where(F.col("sha256").isNotNull()).groupBy("key").agg(F.max(F.struct("sha256", "bytes")).alias("x")).select("key", "x.*")
        found = latest.groupBy("sha256").agg(F.max("bytes").alias("bytes"), F.min("key").alias("_key"))
        held = self.hashes.read(self.hashes.touched(found), min(version - 1, self.hashes.version())).select("sha256")
        new = found.join(held, "sha256", "left_anti")
        contents = batch.select(
            F.col("key").cast("string").alias("_key"), raw.alias("content")
        ).join(new, "_key").where(F.sha2("content", 256) == F.col("sha256")).dropDuplicates(["_key"])  # a key for each hash, as they lie
        contents.select("sha256", "content").write.mode("overwrite").parquet(f"{self.folder}/contents/version={version}")
        self.hashes.merge(new.select("sha256", "bytes", F.lit(version).cast("long").alias("version")), lambda old, rows: old.unionByName(rows), version)
        self.links.merge(latest.select("key", "sha256"), lambda old, rows: upsert(old, rows, ["key"], as_of), version)

    def contents(self) -> DataFrame:
        """``sha256, content`` of all versions that are whole."""
        versions = [f"{self.folder}/contents/version={v}" for v in range(1, self.hashes.version() + 1)]
        return self.spark.read.schema("sha256 string, content binary").parquet(*versions) if versions else self.spark.createDataFrame([], "sha256 string, content binary")


def verify_store(store: DataFrame) -> DataFrame:
    """Stored contents whose bytes no longer have their hash."""
    return store.where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def dataset_manifest(df: DataFrame, keys: list[str], date: str, content: str) -> DataFrame:
    """Rows, bytes, first and last date of each part, and a digest that does not depend on the rows' order."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("records"), F.coalesce(
            F.sum(F.octet_length(F.col(content))), F.lit(0)
        ).cast("long").alias("bytes"), F.date_format(F.min(date), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max(date), "yyyy-MM-dd").alias("last_date"),
        F.bit_xor(F.xxhash64(*[c for c in df.columns if c not in keys])).alias("digest"),
    )


def materialize_monthly(df: DataFrame, path: str, month: str = "month") -> None:
    """Months in the batch replace those months in the table; other months stay."""
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(WRITERS))  # a month's rows go to several writers
    df.repartition(F.col(month), spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def snapshot(kpis: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON document of the figures and small report tables, each of which must be limited already."""
    out = kpis.select(F.to_json(F.struct("*")).alias("kpis"))
    for name, df in sections.items():
        out = out.crossJoin(df.agg(F.to_json(F.sort_array(F.collect_list(F.struct("*")))).alias(name)))
    return out.select(F.to_json(F.struct("*")).alias("document"))
