"""The registered queries of this subpackage, and SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tendril.llm.align import aligned_digests
from tendril.llm.chat import read_back, windows
from tendril.llm.decontaminate import contaminated
from tendril.llm.jaccard import similar_documents
from tendril.llm.language import languages
from tendril.llm.lines import without_repeated_lines
from tendril.llm.mixing import mixed
from tendril.llm.neardup import near_duplicates
from tendril.llm.quality import judged
from tendril.llm.repair import damaged, repaired
from tendril.llm.substrings import digested
from tendril.llm.tokens import tokens_written
from tendril.llm.warc import drill


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(_table(spark, sf_dir, "documents"))


#: A conversation whose texts look like the template's marks.
MARKED = "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(windows(rows.unionByName(spark.sql(MARKED))))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixed(docs).select(
        "doc_id", F.col("_source").alias("source"), F.col("_slot").alias("slot"), F.col("_place").alias("place"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages are written and audited; the copy has a bit turned in one of 97 records."""
    return drill(_table(spark, sf_dir, "pages"), F.col("page_id") % 97 == 13)


def tokenizer_path() -> str:
    """The public tokenizer that the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_written(_table(spark, sf_dir, "documents"), tokenizer_path())


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_digests(_table(spark, sf_dir, "documents"), tokenizer_path(), piece_model_path())


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations are damaged and repaired; those of which no row is left have zeros."""
    rows = _table(spark, sf_dir, "conversations")
    done = repaired(damaged(rows)).withColumnRenamed("conv_id", "_id")
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard": op1_jaccard,
    "op2_embeddings": op2_embeddings,
    "op3_decontaminate": op3_decontaminate,
    "op4_substrings": op4_substrings,
    "op5_chat": op5_chat,
    "op6_mixing": op6_mixing,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_lines": op12_lines,
    "op13_repair": op13_repair,
}
