"""A corpus pipeline: language, near duplicates, benchmark passages, source mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs, so a lost executor repeats a task of one stage. The mixture is an
order of rows: its files are written in that order, and the token files follow it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetledger.llm import decontaminate, language_id, mixing, near_dup, token_orc
from facetledger.llm.queries import END_ID, MIXTURE, table, tokenizer_file
from facetledger.llm.text import small_batches
from facetledger.runtime import checkpoint_dir

ORACLE_SQL = None
NEAR_COPIES = near_dup.Bands(size=5, percent=80)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is not told with a score of one half."""
    small_batches(spark)
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five words, similarity 0.8."""
    small_batches(spark)
    return near_dup.keep_one(docs, NEAR_COPIES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter item."""
    small_batches(spark)
    return decontaminate.remove_affected(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order in which sources have their target weights for as long as they last."""
    small_batches(spark)
    return mixing.in_order(docs, MIXTURE)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files in the order of the rows as they were written, and describes each document from the files."""
    small_batches(spark)
    folder = token_orc.new_folder(spark)
    placed = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    token_orc.write_tokens(placed, folder, tokenizer_file("word_bpe_49k.json"), END_ID, order=["file", "row"])
    return token_orc.describe_tokens(token_orc.read_tokens(spark, folder))


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("mixing", mix_sources), ("token_files", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
    return docs
