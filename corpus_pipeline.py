"""The corpus pipeline: quality, toxicity, line dedup, one document of each near-duplicate group, packing.

Every stage reads documents and all but the last return the columns of documents. The output of a stage
is written as Parquet to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motiondeck.llm import line_dedup, ngram_join, packing, quality_gam, toxicity
from motiondeck.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.5 go."""
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document that had lines and keeps none goes with them. n_chars follows text."""
    columns = docs.columns
    left = line_dedup.dedup_lines(docs).where("__gone = 0 or __gone < __lines")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("__gone") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return left.select(*columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by 0.8 of their five-word shingles stays."""
    return ngram_join.keep_first(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of 2048 tokens, a row a piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_gam", quality),
    ("toxicity_subwords", toxic),
    ("line_simhash", lines),
    ("ngram_trie_join", near_copies),
    ("residual_packing", packed),
]

#: SQL can express none of the trained models; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        docs = out if name == STAGES[-1][0] else materialize(out)
    return docs
