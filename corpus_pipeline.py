"""From raw documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm.decontaminate import without_benchmark
from tendril.llm.jaccard import one_of_each
from tendril.llm.mixing import ADDED, mixed
from tendril.llm.quality import accepted
from tendril.llm.queries import tokenizer_path
from tendril.llm.shared import stored, written_order
from tendril.llm.tokens import tokens_written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones stays, that of the smallest id; a null id comes last."""
    return one_of_each(docs, keep_nulls=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; sources below their target weight repeat some until the mixture has it.

    Rows come in the order of the mixture, over the partitions and within them.
    """
    own = {c: f"own{c}" for c in ADDED if c in docs.columns}  # the mixture would replace columns of these names
    place = ["_slot", "_place"]
    rows = mixed(docs.withColumnsRenamed(own)).repartitionByRange(*place).sortWithinPartitions(*place)
    return rows.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture as sequence files, in the order in which its table was written; a row per document, read back from them."""
    return tokens_written(docs, tokenizer_path(), order=written_order())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
