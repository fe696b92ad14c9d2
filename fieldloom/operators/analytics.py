"""Operational analytics: metrics, failure log, badges, coverage, listings, integrity checks, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T

# ---- fixed values -------------------------------------------------------------------------
LOW_CONFIDENCE = 0.90
BADGE_GREEN, BADGE_AMBER = 90, 70
ACCURACY_MIN_DOCS = 20
# -------------------------------------------------------------------------------------------


def present(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def field_metrics(results: DataFrame, by: Sequence[str] = ("field_key",)) -> DataFrame:
    """Attempts, successes, failures, validation errors and mean confidence per field."""
    ok = present(F.col("value")) & ~F.col("validation_error")
    return results.groupBy(*by).agg(
        F.count("*").alias("total_attempts"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.count_if("validation_error").alias("validation_errors"),
        F.avg("confidence").alias("average_confidence"),
    )


def failure_reason() -> Column:
    return (
        F.when(~present(F.col("value")), "empty_value")
        .when(F.col("validation_error"), "validation_failed")
        .when(F.col("confidence") < LOW_CONFIDENCE, "low_confidence")
    )


def failures(results: DataFrame) -> DataFrame:
    return results.withColumn("reason", failure_reason()).filter(F.col("reason").isNotNull())


def reject_rows(results: DataFrame, ts: Column | None = None) -> DataFrame:
    """The reject log's columns; write with ``append`` mode and a CSV header."""
    return failures(results).select(
        (ts if ts is not None else F.current_timestamp()).alias("timestamp"),
        F.col("field_key").alias("field_code"),
        F.coalesce("value", F.lit("")).alias("extracted_value"),
        F.format_string("%.2f", F.col("confidence")).alias("confidence"),
        "reason",
    )


def badge(confidence: Column) -> Column:
    """Colour of a confidence given as a ratio (up to 1) or as percent."""
    pct = F.floor(F.when(confidence <= 1.0, confidence * 100).otherwise(confidence) + 0.5)
    return F.when(pct >= BADGE_GREEN, "green").when(pct >= BADGE_AMBER, "amber").otherwise("red")


def coverage(mapped: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fields that are no groups, and how many of them hold a value."""
    leaf = mapped.filter(F.col("field_type") != "group")
    return leaf.groupBy(*by).agg(
        F.count("*").alias("total_fields"), F.count_if(present(F.col("value"))).alias("filled_fields"))


def accuracy(extracted: DataFrame, truth: DataFrame, keys: Sequence[str] = ("doc_id", "field_key")) -> DataFrame:
    """Precision, recall and exact rate per document type and field, with subtotals."""
    pairs = truth.withColumnRenamed("value", "true_value").join(
        extracted.select(*keys, F.col("value").alias("got")), list(keys), "full")
    hit = present(F.col("got")) & F.coalesce(F.col("got") == F.col("true_value"), F.lit(False))
    out = pairs.rollup("doc_type", "field_key").agg(
        F.countDistinct("doc_id").alias("docs"),
        F.count_if(present(F.col("true_value"))).alias("expected"),
        F.count_if(present(F.col("got"))).alias("returned"),
        F.count_if(hit).alias("correct"),
    )
    return out.select(
        "doc_type", "field_key", "docs", "expected", "returned", "correct",
        F.round(F.col("correct") / F.nullif(F.col("returned"), F.lit(0)), 6).alias("precision"),
        F.round(F.col("correct") / F.nullif(F.col("expected"), F.lit(0)), 6).alias("recall"),
        F.when(F.col("docs") < ACCURACY_MIN_DOCS, "insufficient corpus").otherwise("evaluated").alias("status"),
    )


def metric_report(totals: DataFrame) -> DataFrame:
    """One row of totals as (Metric, Value) rows for a two-column CSV."""
    cols = ", ".join(f"'{c}', cast({c} as string)" for c in totals.columns)
    return totals.select(F.expr(f"stack({len(totals.columns)}, {cols}) as (Metric, Value)"))


def owner_listing(rows: DataFrame, owner: str, created: str, tie: str, owner_id=None) -> DataFrame:
    """Rows of one owner (or of all, owner by owner), newest first; a range-partitioned sort."""
    mine = rows if owner_id is None else rows.filter(F.col(owner) == owner_id)
    return mine.orderBy(owner, F.col(created).desc(), F.col(tie).desc())


def with_child_count(parents: DataFrame, children: DataFrame, key: str, name: str = "field_count") -> DataFrame:
    counts = children.groupBy(key).agg(F.count("*").alias(name))
    return parents.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def active_sessions(tokens: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Tokens neither revoked nor expired whose user exists."""
    live = tokens.filter(F.col("revoked_at").isNull() & (F.col("expires_at") >= now))
    return live.join(users, "user_id", "left_semi")


def default_asset(assets: DataFrame) -> DataFrame:
    """The first active default by (display_order, id) and the number of defaults, in one aggregation."""
    usable = F.when(F.col("is_default") & F.col("is_active"), F.struct("display_order", "id"))
    return assets.agg(F.min(usable).alias("m"), F.count_if("is_default").alias("defaults")).select(
        "m.id", "m.display_order", "defaults", (F.col("defaults") > 1).alias("too_many"))


def set_default(assets: DataFrame, asset_id: int) -> DataFrame:
    """Make one asset the only default and active."""
    chosen = F.col("id") == asset_id
    return assets.withColumns({"is_default": chosen, "is_active": F.col("is_active") | chosen})


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def partial_update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null incoming attributes replace stored ones."""
    cols = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    return stored.join(new, key, "left").withColumns(
        {c: F.coalesce(f"_new_{c}", c) for c in cols}).drop(*[f"_new_{c}" for c in cols])


def correct_values(stored: DataFrame, corrections: DataFrame) -> DataFrame:
    """Manual corrections win per (doc, canonical name); unknown names are appended with confidence 100."""
    old = stored.select("doc_id", "canonical_name", "field_name", F.col("value").alias("old_value"), "confidence",
                        F.lit(True).alias("_stored"))
    new = corrections.select("doc_id", "canonical_name", F.col("value").alias("new_value"), F.lit(True).alias("_sent"))
    return old.join(new, ["doc_id", "canonical_name"], "full").select(
        "doc_id", "canonical_name",
        F.coalesce("field_name", T.title_case(F.regexp_replace("canonical_name", "_", " "))).alias("field_name"),
        F.when(F.col("_sent"), F.col("new_value")).otherwise(F.col("old_value")).alias("value"),
        F.when(F.col("_stored"), F.col("confidence")).otherwise(F.lit(100)).alias("confidence"),
    )


def latest_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by the order columns (an aggregation, so hot keys combine before the exchange)."""
    rest = [c for c in rows.columns if c not in key]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*key).agg(picked).select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def results_to_json(results: DataFrame) -> DataFrame:
    """``{canonical name: value}`` per document; names in order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("field_key").alias("key"), F.col("value").alias("value"))))
    return results.groupBy("doc_id").agg(entries.alias("e")).select(
        "doc_id", F.to_json(F.map_from_entries("e"), {"ignoreNullFields": "false"}).alias("fields_json"))


def json_to_results(docs: DataFrame) -> DataFrame:
    m = F.from_json("fields_json", "map<string,string>")
    return docs.select("doc_id", F.explode(m).alias("field_key", "value"))
