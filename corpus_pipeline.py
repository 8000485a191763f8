"""The corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, encoding.

``run`` applies the stages to ``documents``. Between stages the rows are written as Parquet
to the shared folder and read again, so each stage reads a stored table and a lost executor
never costs an earlier stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from tickloom.llm.queries import tokenizer
from tickloom.session import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without later copies of lines; documents left without a word go."""
    out = line_dedup.dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates, by five-word shingles and a similarity of 0.8: the one with the smallest id."""
    return ngram_join.keep_first(docs, 5, 80)


def benchmark_free(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text"))


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids and digests of every document that is left."""
    return bpe.encode(docs, tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", benchmark_free),
    ("bpe", encoded),
]

# compression, edit distance and encoding have no SQL form; the stages are tested against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
