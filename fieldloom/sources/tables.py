"""Readers for the star schema and the text tables (Parquet; columns are pruned by the caller's select)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan of few file splits over the cores by key; a scan that is already wide stays as it is.

    Text work is CPU-bound per row, so one small file must not run on one core. On a large input the scan has more
    splits than the cluster has cores and nothing is shuffled here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def prose_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Plain text files, one row per file, read whole."""
    return (
        spark.read.text(path, wholetext=True)
        .select(
            F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"),
            F.col("_metadata.file_name").alias("file_name"),
            F.col("value").alias("text"),
        )
    )
