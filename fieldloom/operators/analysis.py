"""One analysis of a corpus from end to end: requested names to full result rows.

Extractors and the rule cascade fill what they are sure of. What they leave open is written once as a table of its own; only
documents with an open field go on to discovery, matching and ranking, whose scored candidates are written once too, as
the winner and the ranked list both come from them. Cleaning, validation and the page close the row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T
from ..session import shared_folder
from ..sources import dictionaries as Dic
from ..sources import intake as I
from . import derive as V
from . import discovery as D
from . import layout as B
from . import resolve as R
from . import rules as E
from . import scored as C

NO_CANDIDATE = "No candidates found"
SCORES = ["semantic", "fuzzy", "context", "validation", "ocr_confidence"]
SCORE_TYPE = "struct<semantic:double,fuzzy:double,context:double,validation:double,ocr:double>"
RANKED_TYPE = f"array<struct<rank:int,label:string,value:string,source_line:int,strategy:string,scores:{SCORE_TYPE},final_score:double,explanation:string>>"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; without one (local sessions) it is checkpointed where the session says, or kept in memory."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return df.persist()
    path = f"{folder.rstrip('/')}/fieldloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def canonical_names(docs: DataFrame, requests: Sequence[str]) -> dict[str, str]:
    """The field key of each requested name."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(n,) for n in dict.fromkeys(requests)], "name string")
    rows = R.canonical_keys(names, Dic.display_names(spark), Dic.aliases(spark)).select("name", "canonical_name").collect()
    return {r["name"]: r["canonical_name"] for r in rows}


def explanation(weights: dict[str, float] = R.WEIGHTS) -> Column:
    """How the parts of a candidate's score add up, as text."""
    parts = [("semantic", "semantic"), ("fuzzy", "fuzzy"), ("ocr", "ocr_confidence"), ("context", "context"), ("validation", "validation")]
    texts = [F.format_string(f"{name}=%.2f (wt={weights[name]:.2f})", F.col(column).cast("double")) for name, column in parts]
    return F.concat_ws(" | ", F.format_string("Final Score: %.3f", F.col("final_score")), *texts)


def _scores() -> Column:
    return F.struct(*[F.col(c).cast("double").alias("ocr" if c == "ocr_confidence" else c) for c in SCORES])


def sure_values(docs: DataFrame, keys: Sequence[str], key: str = "doc_id") -> DataFrame:
    """What extractors and rules find: the cascade runs on fields that no extractor is sure of, and its hit replaces theirs."""
    own = C.extractor_set(docs, keys, key).select(key, "field_key", "value", "confidence")
    rules = E.cascade(docs, keys, stored=own, key=key).select(
        key, "field_key", *[F.col(c).alias(f"r_{c}") for c in ("value", "confidence", "matched_label", "source_line", "match_type")])
    both = own.join(rules, [key, "field_key"], "full_outer")
    ruled = F.coalesce(F.col("r_value") != "", F.lit(False))
    pick = lambda c: F.when(ruled, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    only = lambda c: F.when(ruled, F.col(f"r_{c}")).alias(c)
    return both.select(key, "field_key", pick("value"), pick("confidence"), only("matched_label"), only("source_line"), only("match_type")).where("value <> ''")


def late_values(docs: DataFrame, wanted: DataFrame, requests: Sequence[str], key: str = "doc_id", vectors: DataFrame | None = None) -> DataFrame:
    """Ranked candidates of the (document, field_name) pairs in ``wanted``, and the accepted one or the reason for none."""
    found = R.with_regex_candidates(R.retrieve(D.candidates(docs, [key]), requests, vectors), docs, requests, key)
    scored = R.score(found, docs, requests, key).join(wanted, [key, "field_name"], "left_semi")
    scored = written(scored.withColumn("explanation", explanation()), "scored")
    top = R.best(scored, key)
    one = F.struct(F.col("rank").cast("int").alias("rank"), "label", "value", F.col("source_line").cast("int").alias("source_line"), "strategy",
                   _scores().alias("scores"), "final_score", "explanation")
    lists = R.ranked(scored, key).groupBy(key, "field_name").agg(
        F.array_sort(F.collect_list(one)).alias("ranked_candidates"))
    rows = R.accept(docs, top, requests, key).join(wanted, [key, "field_name"], "left_semi").join(lists, [key, "field_name"], "left")
    best = F.get("ranked_candidates", F.lit(0))["explanation"]
    return rows.select(
        key, "field_name", "value", "confidence", "matched_label", F.col("source_line").cast("int").alias("source_line"), F.col("strategy").alias("match_type"), "reason",
        F.when(F.col("ranked_candidates").isNull(), F.lit(None)).otherwise(_scores()).cast(SCORE_TYPE).alias("scores"),
        F.when(best.isNull(), NO_CANDIDATE).when(F.col("value").isNull(), F.concat(F.lit("Best candidate had low score: "), best)).otherwise(best).alias("explanation"),
        F.col("ranked_candidates").cast(RANKED_TYPE).alias("ranked_candidates"))


def with_pages(rows: DataFrame, docs: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """source_page: the first page that has the text of a row's line; 1 where there is none."""
    at = rows.where("source_line is not null").select(key, "source_line").distinct()
    lines = D.line_rows(docs, [key]).select(key, F.col("line_no").cast("int").alias("source_line"), F.col("text").alias("matched_text"))
    found = B.page_of_line(at.join(lines, [key, "source_line"]), I.line_table(pages), key).select(key, "source_line", "source_page")
    return rows.join(found, [key, "source_line"], "left").withColumn("source_page", F.coalesce("source_page", F.lit(1)))


def analyse(docs: DataFrame, requests: Sequence[str], pages: DataFrame | None = None, key: str = "doc_id", vectors: DataFrame | None = None) -> DataFrame:
    """One full result row for each document and requested name.

    docs needs the key and text, pages (if given) the key, page and lines. Columns: field_name, canonical_name, value,
    confidence (percent, truncated), source_page, source_line, matched_label, match_type, source_method, validation_error and
    -message, reason, scores, explanation and ranked_candidates. Values of extractors have no line; scores and ranked
    candidates belong to values that were ranked. A value that fails its check keeps its text and has confidence 0.
    """
    names = canonical_names(docs, requests)
    requests = list(dict.fromkeys(requests))
    docs = docs.select(key, "text")
    canonical = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    asked = docs.select(key, F.explode(F.array(*map(F.lit, requests))).alias("field_name")).withColumn("canonical_name", canonical[F.col("field_name")])
    sure = written(sure_values(docs, sorted(set(names.values())), key), "sure")
    known = asked.join(sure.withColumnRenamed("field_key", "canonical_name"), [key, "canonical_name"])
    wanted = written(asked.join(known.select(key, "field_name"), [key, "field_name"], "left_anti").select(key, "field_name"), "open")
    late = late_values(docs.join(wanted.select(key).distinct(), key, "left_semi"), wanted, requests, key, vectors)
    none = lambda kind: F.lit(None).cast(kind)
    rows = known.select(key, "field_name", "value", F.col("confidence").cast("double").alias("confidence"), "matched_label", F.col("source_line").cast("int").alias("source_line"),
                        "match_type", none("string").alias("reason"), none(SCORE_TYPE).alias("scores"), none("string").alias("explanation"),
                        none(RANKED_TYPE).alias("ranked_candidates")).unionByName(late)
    rows = with_pages(rows, docs, pages, key) if pages is not None else rows.withColumn("source_page", F.lit(1))
    rows = rows.withColumn("field_key", canonical[F.col("field_name")])
    checked = V.validate(rows.withColumn("value", F.when(F.col("value") != "", V.clean_field(F.col("field_key"), F.col("value")))))
    return checked.select(
        key, "field_name", F.col("field_key").alias("canonical_name"), "value", (F.coalesce("confidence", F.lit(0.0)) * 100).cast("int").alias("confidence"), "source_page",
        "source_line", "matched_label", "match_type", F.when(F.coalesce("value", F.lit("")) != "", "rule_based").alias("source_method"), "validation_error",
        F.when(F.col("validation_error"), F.concat(F.lit("Field validation failed for "), F.col("field_name"))).otherwise(F.col("reason")).alias("validation_message"),
        "reason", "scores", "explanation", "ranked_candidates")
