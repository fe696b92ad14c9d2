"""Registered queries of the incremental runs: each drains its stream, then reads what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..streaming import incremental as J
from . import sqlkit as S
from .queries_base import collector
from .text_queries import GATED

QUERIES, ORACLES, query = collector()


@query("j1_stream_candidates", S.with_(GATED, "SELECT strategy, count(*) AS n, count(DISTINCT doc_id) AS docs FROM good WHERE corpus = 'prose' GROUP BY 1"))
def j1(spark, d):
    docs = J.table_stream(spark, d, "documents").select("doc_id", "text")
    out = J.work_folder(spark, "candidates")
    J.stream_candidates(docs, f"{out}/data", f"{out}/checkpoint", ["doc_id"])
    return spark.read.parquet(f"{out}/data").groupBy("strategy").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


EVENT_RESULTS = {"field_key": "event_type", "value": "CASE WHEN value > 5 THEN props END", "confidence": "least(value / 100, 1.0)",
                 "validation_error": "user_id % 7 = 0"}


def results(spark, d):
    return J.table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), *[F.expr(v).alias(k) for k, v in EVENT_RESULTS.items()])


@query("j2_running_metrics", "WITH r AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in EVENT_RESULTS.items()) + """ FROM events)
SELECT field_key, count(*) AS total_attempts, count(*) FILTER (WHERE coalesce(value, '') <> '' AND NOT validation_error) AS successes,
  count(*) FILTER (WHERE NOT (coalesce(value, '') <> '' AND NOT validation_error)) AS failures, count(*) FILTER (WHERE validation_error) AS validation_errors,
  round(avg(confidence), 6) AS average_confidence FROM r GROUP BY 1""")
def j2(spark, d):
    out = J.work_folder(spark, "metrics")
    J.stream_metrics(results(spark, d), f"{out}/data", f"{out}/checkpoint")
    latest = A.latest_per_key(spark.read.parquet(f"{out}/data"), ["field_key"], ["version"]).drop("version")
    return latest.withColumn("average_confidence", F.round("average_confidence", 6))


@query("j2_hourly_metrics", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS field_key, count(*) AS attempts, round(avg(least(value / 100, 1.0)), 6) AS average_confidence FROM events GROUP BY 1, 2")
def j2b(spark, d):
    out = J.work_folder(spark, "hourly")
    J.stream_hourly_metrics(results(spark, d), f"{out}/data", f"{out}/checkpoint")
    return J.latest_batch(spark, f"{out}/data", ["hour", "field_key"]).select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "field_key", "attempts", F.round("average_confidence", 6).alias("average_confidence"))


@query("j3_latest_corrections", "SELECT user_id AS doc_id, event_type AS canonical_name, arg_max(props, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def j3(spark, d):
    c = J.table_stream(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("canonical_name"), F.col("props").alias("value"))
    out = J.work_folder(spark, "corrections")
    J.stream_corrections(c, f"{out}/data", f"{out}/checkpoint")
    return A.latest_per_key(spark.read.parquet(f"{out}/data"), ["doc_id", "canonical_name"], ["ts", "event_id"]).select("doc_id", "canonical_name", "value")
