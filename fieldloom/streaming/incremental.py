"""Incremental runs: documents to candidates, running field metrics, latest correction per document field."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import analytics as A
from ..operators import discovery as D
from ..session import shared_folder


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared folder; a local one only where none is set (tests)."""
    base = shared_folder(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-fieldloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of files."""
    table = f"{folder}/{name}.parquet"
    there = spark.read.parquet(table)
    stream = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_batch)
    # a single file is found by its name in the folder of all tables, the files of a folder have other names
    if any(f"/{name}.parquet/" in f for f in there.inputFiles()):
        return stream.parquet(table)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, mode: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is there, then stop; a restart goes on from the checkpoint."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def stream_candidates(docs: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """New documents to gated candidates. Discovery is row-local, so it runs on the stream itself, without state."""
    q = (
        D.quality_gate(D.discover(docs, keys)).drop("ord").writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def stream_metrics(results: DataFrame, out: str, checkpoint: str) -> None:
    """Running metrics per field; every batch writes the whole (small) result as a new version."""
    run_available(A.field_metrics(results), "complete", checkpoint,
                  lambda df, n: df.write.mode("overwrite").parquet(f"{out}/version={n}"))


def stream_hourly_metrics(results: DataFrame, out: str, checkpoint: str, late: str = "1 hour") -> None:
    """Attempts and mean confidence per field and hour; updates are appended per batch, the latest batch wins."""
    hourly = results.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "field_key").agg(
        F.count("*").alias("attempts"), F.avg("confidence").alias("average_confidence"))
    flat = hourly.select(F.col("w.start").alias("hour"), "field_key", "attempts", "average_confidence")
    run_available(flat, "update", checkpoint, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))


def latest_batch(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    return A.latest_per_key(spark.read.parquet(out), keys, ["batch"]).drop("batch")


def stream_corrections(corrections: DataFrame, out: str, checkpoint: str, late: str = "7 days") -> None:
    """Last write wins per (document, name); each batch keeps its own winners, readers take the latest of them."""
    def sink(df: DataFrame, n: int) -> None:
        A.latest_per_key(df, ["doc_id", "canonical_name"], ["ts", "event_id"]).write.mode("overwrite").parquet(f"{out}/batch={n}")

    run_available(corrections.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), "append", checkpoint, sink)
