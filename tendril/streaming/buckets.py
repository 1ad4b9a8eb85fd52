"""Keyed tables in buckets of which a batch reads and writes only those that it meets.

A row's bucket is the hash of its key.  ``data-n`` holds the buckets that version n wrote
anew, ``manifest-n.json`` says for each bucket which version has it.  A version is there
when its manifest is, which is renamed into place at the end: a run that ends halfway
leaves the version before, and one that runs again writes the same version again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tendril.catalog import parts_of, roomy

#: Slices of a bucket for each task that its rows ask for, so that tasks get about as many rows.
SLICES = 4


class BucketTable:
    """A table under ``folder`` by ``keys``, in ``buckets`` buckets; null keys have a bucket as others do."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: str | StructType, buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
        self.Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _listed(self, path: str) -> list[str]:
        place = self.Path(path)
        return [s.getPath().getName() for s in self.fs.listStatus(place)] if self.fs.exists(place) else []

    def version(self) -> int:
        """The last version that is whole, 0 if there is none."""
        names = [n for n in self._listed(self.folder) if n.startswith("manifest-")]
        return max((int(n.removeprefix("manifest-").removesuffix(".json")) for n in names), default=0)

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket to the version that wrote it."""
        if not version:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifest-{version}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def counts(self, batch: DataFrame) -> dict[int, int]:
        """The buckets of a batch's keys with the batch's rows in them: at most as many numbers as there are buckets."""
        return {r.b: r.n for r in batch.groupBy(self.bucket().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def touched(self, batch: DataFrame) -> list[int]:
        return sorted(self.counts(batch))

    def read(self, only: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or only some of its buckets."""
        held = self.manifest(self.version() if version is None else version)
        paths = [f"{self.folder}/data-{v}/_bucket={b}" for b, v in sorted(held.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, rows: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> bool:
        """Version ``version`` (the next by default): the buckets of ``batch`` become ``rows(their rows, batch)``.

        False, and nothing is done, if that version is there already.  A bucket of many
        rows is written by many tasks, each a slice of its keys.
        """
        now = self.version()
        version = now + 1 if version is None else version
        if now >= version:
            return False
        counts = self.counts(batch)
        only = sorted(counts)
        old = self.read(only, now)
        total = old.count() + sum(counts.values())
        slices = 1 if parts_of(total) <= max(1, len(only)) else -(-SLICES * parts_of(total) // len(only))
        with roomy(self.spark, total):
            after = rows(old, batch).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn("_bucket", self.bucket())
            dealt = after.repartition("_bucket", F.pmod(F.hash(*self.keys), F.lit(slices)))
            dealt.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/data-{version}")
        written = {int(n.removeprefix("_bucket=")) for n in self._listed(f"{self.folder}/data-{version}") if n.startswith("_bucket=")}
        held = {b: v for b, v in self.manifest(now).items() if b not in set(only)} | dict.fromkeys(written, version)
        self._commit(version, held)
        return True

    def _commit(self, version: int, held: dict[int, int]) -> None:
        own, name = self.Path(f"{self.folder}/.manifest-{version}"), self.Path(f"{self.folder}/manifest-{version}.json")
        out = self.fs.create(own, True)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not self.fs.rename(own, name):
            raise OSError(f"{name.toString()} is there already")

    def clean(self, keep: int = 2) -> None:
        """Removes manifests but the last ``keep``, and data that none of those names."""
        now = self.version()
        old = [v for v in range(1, now - keep + 1) if self.fs.exists(self.Path(f"{self.folder}/manifest-{v}.json"))]
        held = {(b, v) for k in range(max(1, now - keep + 1), now + 1) for b, v in self.manifest(k).items()}
        for v in old:
            self.fs.delete(self.Path(f"{self.folder}/manifest-{v}.json"), False)
        for name in self._listed(self.folder):
            if name.startswith("data-") and (v := int(name.removeprefix("data-"))) <= now:
                for b in self._listed(f"{self.folder}/{name}"):
                    if b.startswith("_bucket=") and (int(b.removeprefix("_bucket=")), v) not in held:
                        self.fs.delete(self.Path(f"{self.folder}/{name}/{b}"), True)
