"""Registered queries of intake, sinks and operational analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import discovery as D
from ..sources import forms as Fm
from ..sources import intake as I
from ..sources.tables import prose_documents, table
from . import sqlkit as S
from .queries_base import collector

QUERIES, ORACLES, query = collector()

# one extraction result per line item: the stand-in for a result table of the same size
RESULT_EXPRS = {
    "doc_id": "l_orderkey",
    "field_key": "'field_' || CAST(l_linenumber AS STRING)",
    "value": "CASE WHEN l_tax < 0.01 THEN NULL WHEN l_tax > 0.075 THEN '' ELSE CAST(l_partkey AS STRING) END",
    "confidence": "round(1.0 - 2 * l_discount, 2)",
    "validation_error": "(l_returnflag = 'R' AND l_suppkey % 3 = 0)",
}
RESULTS = "results AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in RESULT_EXPRS.items()) + " FROM lineitem)"


def results(spark, d):
    return table(spark, d, "lineitem").select(*[F.expr(v).alias(k) for k, v in RESULT_EXPRS.items()])


REASON = """CASE WHEN value IS NULL OR value = '' THEN 'empty_value' WHEN validation_error THEN 'validation_failed'
  WHEN confidence < 0.90 THEN 'low_confidence' END"""


# ---- A: sources and sinks -------------------------------------------------------------------
@query("a1_text_scan", "SELECT doc_id, md5(text) AS text_md5, length(text) AS chars FROM documents")
def a1(spark, d):
    return prose_documents(spark, d).select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("chars"))


PAGE_FILE = ("split_part(split_part(url, '?', 1), '#', 1) || CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' "
             "WHEN 2 THEN '.jpeg' WHEN 3 THEN '.gif' ELSE '' END")


@query("a2_admission_check", f"""SELECT page_id, file_name, n_bytes,
  CASE WHEN lower(regexp_extract(file_name, '[^.](\\.[^.]+)$', 1)) NOT IN ('.png', '.jpg', '.jpeg') THEN 'suffix'
       WHEN n_bytes > 5242880 THEN 'too_large' END AS reject_reason
  FROM (SELECT page_id, regexp_extract({PAGE_FILE}, '([^/\\\\]*)$', 1) AS file_name, octet_length(encode(html)) AS n_bytes FROM pages)""")
def a2(spark, d):
    files = table(spark, d, "pages").select(
        "page_id", I.base_name(F.expr(PAGE_FILE)).alias("file_name"), F.octet_length("html").alias("n_bytes"))
    return I.admit(files)


@query("a5_result_json", f"""WITH {RESULTS},
u AS (SELECT doc_id, field_key, value FROM results)
SELECT doc_id, '{{' || string_agg('"' || field_key || '":' || CASE WHEN value IS NULL THEN 'null' ELSE '"' || value || '"' END, ','
  ORDER BY field_key) || '}}' AS fields_json FROM (SELECT doc_id, field_key, max(value) AS value FROM u GROUP BY 1, 2) GROUP BY doc_id""")
def a5(spark, d):
    return A.results_to_json(results(spark, d).groupBy("doc_id", "field_key").agg(F.max("value").alias("value")))


@query("a6_reject_log", f"""WITH {RESULTS}, j AS (SELECT *, {REASON} AS reason FROM results)
SELECT field_key AS field_code, coalesce(value, '') AS extracted_value, printf('%.2f', confidence) AS confidence, reason
FROM j WHERE reason IS NOT NULL""")
def a6(spark, d):
    return A.reject_rows(results(spark, d)).drop("timestamp")


@query("a7_audit_trail", """SELECT event_type AS action, count(*) AS entries, count(DISTINCT user_id) AS users,
  sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS detail_sum, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
  FROM events GROUP BY 1""")
def a7(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("action")).agg(
        F.count("*").alias("entries"), F.countDistinct("user_id").alias("users"),
        F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("detail_sum"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("a8_accuracy_report", f"""WITH {RESULTS}, t AS (SELECT count(*) AS n, count(DISTINCT doc_id) AS documents,
  count(*) FILTER (WHERE coalesce(value, '') <> '' AND NOT validation_error) AS successes FROM results)
SELECT 'status' AS "Metric", CASE WHEN documents < 20 THEN 'Insufficient evaluation corpus' ELSE 'Evaluation completed successfully' END AS "Value" FROM t
UNION ALL SELECT 'document_count', CAST(documents AS STRING) FROM t UNION ALL SELECT 'attempts', CAST(n AS STRING) FROM t
UNION ALL SELECT 'successes', CAST(successes AS STRING) FROM t""")
def a8(spark, d):
    m = A.field_metrics(results(spark, d), by=["doc_id"])
    totals = m.agg(F.count("*").alias("document_count"), F.sum("total_attempts").alias("attempts"), F.sum("successes").alias("successes"))
    return A.metric_report(totals.select(
        F.when(F.col("document_count") < A.ACCURACY_MIN_DOCS, "Insufficient evaluation corpus")
        .otherwise("Evaluation completed successfully").alias("status"), "*"))


@query("a9_bundle_keying", S.with_(S.FORMS, """SELECT case_id, upper(regexp_replace(file_name, '\\.[^.]+$', '')) AS source_name,
  max(doc_id) AS doc_id, max_by(file_name, doc_id) AS file_name, count(*) - 1 AS replaced FROM forms GROUP BY 1, 2"""))
def a9(spark, d):
    return I.bundle(Fm.form_documents(spark, d).select("case_id", "doc_id", "file_name"))


# ---- H: analytics ---------------------------------------------------------------------------
@query("h1_field_metrics", f"""WITH {RESULTS} SELECT field_key, count(*) AS total_attempts,
  count(*) FILTER (WHERE coalesce(value, '') <> '' AND NOT validation_error) AS successes,
  count(*) FILTER (WHERE NOT (coalesce(value, '') <> '' AND NOT validation_error)) AS failures,
  count(*) FILTER (WHERE validation_error) AS validation_errors, round(avg(confidence), 6) AS average_confidence FROM results GROUP BY 1""")
def h1(spark, d):
    return A.field_metrics(results(spark, d)).withColumn("average_confidence", F.round("average_confidence", 6))


@query("h2_failure_reasons", f"""WITH {RESULTS}, j AS (SELECT *, {REASON} AS reason FROM results)
SELECT field_key, reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY 1, 2""")
def h2(spark, d):
    return A.failures(results(spark, d)).groupBy("field_key", "reason").agg(F.count("*").alias("n"))


@query("h3_review_badges", f"""WITH {RESULTS}, p AS (SELECT field_key, floor(CASE WHEN confidence <= 1.0 THEN confidence * 100 ELSE confidence END + 0.5) AS pct FROM results)
SELECT field_key, CASE WHEN pct >= 90 THEN 'green' WHEN pct >= 70 THEN 'amber' ELSE 'red' END AS badge, count(*) AS n FROM p GROUP BY 1, 2""")
def h3(spark, d):
    return results(spark, d).groupBy("field_key", A.badge(F.col("confidence")).alias("badge")).agg(F.count("*").alias("n"))


@query("h4_mapping_coverage", f"""WITH {RESULTS} SELECT doc_id, count(*) AS total_fields,
  count(*) FILTER (WHERE coalesce(value, '') <> '') AS filled_fields FROM results WHERE field_key <> 'field_7' GROUP BY 1""")
def h4(spark, d):
    r = results(spark, d).withColumn("field_type", F.when(F.col("field_key") == "field_7", "group").otherwise("AUTO"))
    return A.coverage(r, ["doc_id"])


TRUTH_FIELDS = {"survey_number": ("Survey Number", "survey"), "district": ("District", "district"),
                "pan_number": ("PAN No", "pan"), "inspection_date": ("Date of Inspection", "d_slash"),
                "owner_name": ("Owner Name", "'Mr. ' || owner")}
_truth_sql = " UNION ALL ".join(
    f"SELECT o_orderkey AS doc_id, c_mktsegment AS doc_type, '{k}' AS field_key, {c} AS true_value FROM facts" for k, (_, c) in TRUTH_FIELDS.items())
_label_sql = " ".join(f"WHEN '{lab}' THEN '{k}'" for k, (lab, _) in TRUTH_FIELDS.items())


@query("h6_accuracy", S.with_(S.FORM_LINES, f"""
, kv AS (SELECT doc_id, CASE regexp_extract(text, {S.lit('^([^:=–—-]{2,60}?)' + '[ ]*[:=–—-]')}, 1) {_label_sql} END AS field_key,
   line_no, regexp_extract(text, {S.lit('^[^:=–—-]{2,60}[:=–—-][ :=–—-]*(.+)$')}, 1) AS got FROM flines),
ext AS (SELECT doc_id, field_key, min_by(got, line_no) AS got FROM kv WHERE field_key IS NOT NULL AND got <> '' GROUP BY 1, 2),
truth AS ({_truth_sql}),
p AS (SELECT coalesce(t.doc_id, e.doc_id) AS doc_id, doc_type, coalesce(t.field_key, e.field_key) AS field_key, true_value, got
      FROM truth t FULL JOIN ext e ON t.doc_id = e.doc_id AND t.field_key = e.field_key)
SELECT doc_type, field_key, count(DISTINCT doc_id) AS docs, count(*) FILTER (WHERE true_value <> '') AS expected,
  count(*) FILTER (WHERE got <> '') AS returned, count(*) FILTER (WHERE got <> '' AND got = true_value) AS correct,
  round(count(*) FILTER (WHERE got <> '' AND got = true_value) / nullif(count(*) FILTER (WHERE got <> ''), 0), 6) AS precision,
  round(count(*) FILTER (WHERE got <> '' AND got = true_value) / nullif(count(*) FILTER (WHERE true_value <> ''), 0), 6) AS recall,
  CASE WHEN count(DISTINCT doc_id) < 20 THEN 'insufficient corpus' ELSE 'evaluated' END AS status
FROM p GROUP BY ROLLUP (doc_type, field_key)""".replace("\n, kv", ",\nkv", 1)))
def h6(spark, d):
    facts = Fm.form_facts(spark, d)
    pairs = ", ".join(f"'{k}', {c}" for k, (_, c) in TRUTH_FIELDS.items())
    truth = facts.select(F.col("o_orderkey").alias("doc_id"), F.col("c_mktsegment").alias("doc_type"),
                         F.expr(f"stack({len(TRUTH_FIELDS)}, {pairs}) as (field_key, value)"))
    docs = Fm.form_documents(spark, d).select("doc_id", "text")
    kv = D.key_values(docs, ["doc_id"])
    names = {lab: k for k, (lab, _) in TRUTH_FIELDS.items()}
    key = F.create_map(*[F.lit(x) for kv_ in names.items() for x in kv_])
    ext = kv.withColumn("field_key", key[F.col("label")]).filter(F.col("field_key").isNotNull())
    ext = ext.groupBy("doc_id", "field_key").agg(F.min_by("value", "source_line").alias("value"))
    return A.accuracy(ext, truth)


@query("h7_owner_listing", "SELECT user_id, event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created FROM events")
def h7(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return A.owner_listing(ev, "user_id", "ts", "event_id").select(
        "user_id", "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("h8_template_field_count", "SELECT s_suppkey AS template_id, s_name AS template_name, count(l_orderkey) AS field_count FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2")
def h8(spark, d):
    t = table(spark, d, "supplier").select(F.col("s_suppkey").alias("template_id"), F.col("s_name").alias("template_name"))
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("template_id"))
    return A.with_child_count(t, f, "template_id")


NOW = "2024-01-20 00:00:00"
TOKENS = {"token_id": "event_id", "user_id": "user_id", "expires_at": "ts + INTERVAL 7 DAY",
          "revoked_at": "CASE WHEN event_type = 'error' THEN ts END"}


@query("h9_active_sessions", "WITH t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in TOKENS.items()) + f""" FROM events)
SELECT token_id, user_id FROM t WHERE revoked_at IS NULL AND expires_at >= TIMESTAMP '{NOW}' AND user_id IN (SELECT c_custkey FROM customer)""")
def h9(spark, d):
    tok = table(spark, d, "events").select(*[F.expr(v).alias(k) for k, v in TOKENS.items()])
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return A.active_sessions(tok, users, F.lit(NOW).cast(dict(tok.dtypes)["expires_at"])).select("token_id", "user_id")


ASSETS = {"id": "s_suppkey", "is_default": "s_acctbal > 5000", "is_active": "s_acctbal < 9000", "display_order": "s_nationkey"}
ASSETS_SQL = "assets AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in ASSETS.items()) + " FROM supplier)"


@query("h10_default_asset", f"""WITH {ASSETS_SQL}, p AS (SELECT id, display_order FROM assets WHERE is_default AND is_active ORDER BY display_order, id LIMIT 1)
SELECT p.id, p.display_order, n.defaults, n.defaults > 1 AS too_many FROM p, (SELECT count(*) AS defaults FROM assets WHERE is_default) n""")
def h10(spark, d):
    a = table(spark, d, "supplier").select(*[F.expr(v).alias(k) for k, v in ASSETS.items()])
    return A.default_asset(a)


@query("h11_orphans", "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def h11(spark, d):
    docs = table(spark, d, "documents").filter("lang = 'en'").select("doc_id")
    return A.orphans(table(spark, d, "labels").select("doc_id", "quality"), docs, "doc_id")


CHANGES = {"id": "s_suppkey", "name": "CASE WHEN s_acctbal > 0 THEN s_name END", "balance": "CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal END"}


@query("h12_partial_update", "WITH ch AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CHANGES.items()) + """ FROM supplier)
SELECT c_custkey AS id, coalesce(ch.name, c_name) AS name, coalesce(ch.balance, c_acctbal) AS balance FROM customer LEFT JOIN ch ON ch.id = c_custkey""")
def h12(spark, d):
    ch = table(spark, d, "supplier").select(*[F.expr(v).alias(k) for k, v in CHANGES.items()])
    st = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return A.partial_update(st, ch, "id")


@query("h13_uniqueness", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def h13(spark, d):
    return A.duplicates(table(spark, d, "part").select("p_name"), ["p_name"])
