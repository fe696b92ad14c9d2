"""The training-text pipeline: quality rules, near-duplicates, decontamination, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldloom.llm import decontam, line_rules, mixing, near_dup, sharding
from fieldloom.llm.base import DOCUMENT, cut, documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, rejected documents go; n_chars follows the text that stays.

    Null, empty and blank texts are rejected. Repeated rows are judged alike and stay as often as given; an empty table stays empty.
    """
    judged = line_rules.clean_lines(docs, DOCUMENT).where("kept")
    return judged.select("doc_id", F.col("clean_text").alias("text"), "lang", "source",
                         F.length("clean_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity of 0.8 or more).

    That is the smallest doc_id; equal rows of one doc_id are one document. Rows without doc_id or without words stay.
    """
    return near_dup.first_of_groups(docs.select(*DOCUMENT))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go.

    Null or empty texts on either side and items without id match nothing. Repeated rows go or stay together.
    """
    return decontam.decontaminated(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Null sources are one source, the last. Rows without words go. Repeated rows share their copies evenly; an empty table stays empty.
    """
    return mixing.mix_documents(docs.select(*DOCUMENT))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document of the mixture.

    A null text has size 8 and checksum 0. Repeated rows get slots of their own; ties between equal rows are broken arbitrarily
    without effect on sizes. An empty table gives none.
    """
    rows = sharding.balanced_shards(sharding.narrow_documents(docs))
    return rows.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]
#: The draws of the mixture and the moves between shards follow hashes that SQL does not have; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages after one another; each result is written to the shared folder and read back for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
