"""Registered queries of derivation, cleaning, validation and area conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import derive as V
from ..operators import discovery as D
from ..operators import label_search as L
from ..operators import resolve as R
from ..sources import dictionaries as Dic
from ..sources import forms as Fm
from ..sources.tables import prose_documents, table
from . import sqlkit as S
from .mapping_queries import any_of
from .queries_base import collector
from .resolve_queries import ALIASES, CANON, DISPLAY, NAMES, rows_sql

QUERIES, ORACLES, query = collector()


def forms(spark, d):
    return Fm.form_documents(spark, d).select("doc_id", "text")


def _has(*w):
    return any_of("lower(text)", list(w))


FLAGS = {
    "valuation_purpose": f"CASE WHEN {_has('housing loan', 'home loan', 'retail loan')} THEN 'Home Loan Valuation' WHEN {_has('mortgage')} THEN 'Mortgage Valuation' WHEN {_has('purchase')} THEN 'Purchase of Property' ELSE 'Purchase / Construction Loan' END",
    "property_tenure": f"CASE WHEN {_has('lease')} THEN 'Leasehold' ELSE 'Freehold' END",
    "prohibited_property_details": f"CASE WHEN contains(lower(text), 'prohibited') THEN substr({S.strip(chr(39).join(['regexp_extract(text, ', '(?i)[^' + chr(92) + 'n]*prohibited[^' + chr(92) + 'n]*', ', 0)']))}, 1, 150) WHEN {_has('22-a', '22a')} THEN 'Yes, under prohibited category' ELSE 'No, not in prohibited list' END",
    "is_prohibited": f"CASE WHEN {_has('prohibited', '22-a', '22a')} THEN 'Yes' ELSE 'No' END",
    "legal_opinion": f"CASE WHEN {_has('dispute', 'litigation', 'court case')} THEN 'Pending legal dispute / litigation found' ELSE 'Clear and marketable title. Recommended for financing.' END",
    "is_disputed": f"CASE WHEN {_has('dispute', 'litigation', 'court case')} THEN 'Yes' ELSE 'No' END",
    "mortgage_details": f"CASE WHEN {_has('mortgage', 'charge created')} THEN 'Prior mortgage / charge created' ELSE 'No prior mortgage or charge exists. Clear for financing.' END",
    "ftl_buffer_zone_details": f"CASE WHEN {_has('ftl', 'buffer zone', 'water body')} THEN 'FTL / Buffer zone check recommended' ELSE 'Not under FTL or Buffer Zone' END",
    "approved_plan_verified": "'Yes, Verified'",
}
FLAG_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS field_key, {v} AS value, {1.0 if k == 'approved_plan_verified' else 0.8}::DOUBLE AS confidence, true AS derived_default FROM {{src}}" for k, v in FLAGS.items())


@query("f1_derived_flags", S.with_(S.FORMS, FLAG_SQL.format(src="forms")))
def f1(spark, d):
    return V.derive_flags(forms(spark, d))


@query("f1_derived_flags_prose", FLAG_SQL.format(src="documents"))
def f1b(spark, d):
    return V.derive_flags(prose_documents(spark, d))


def _first(ps):
    return "coalesce(" + ", ".join(f"nullif({S.strip(f'regexp_extract(text, {S.lit(p)}, 1)')}, '')" for p in ps) + ")"


@query("f2_derived_dates", S.with_(S.FORMS + f""",
x AS (SELECT doc_id, {_first(V.INSPECTION_PATTERNS)} AS i, {_first(V.VALUATION_PATTERNS)} AS v, nullif(regexp_extract(text, {S.lit(V.ANY_DATE_LINE)}, 1), '') AS a FROM forms)""",
    """SELECT doc_id, coalesce(i, a) AS inspection_date, CASE WHEN i IS NOT NULL THEN 0.9 WHEN a IS NOT NULL THEN 0.7 END::DOUBLE AS inspection_confidence,
  coalesce(v, i, a) AS valuation_date, CASE WHEN v IS NOT NULL THEN 0.9 WHEN coalesce(i, a) IS NOT NULL THEN 0.7 END::DOUBLE AS valuation_confidence FROM x"""))
def f2(spark, d):
    return forms(spark, d).select("doc_id", V.derive_dates(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("f3_derived_owner")
def f3(spark, d):
    none = F.lit(None).cast("string")
    return forms(spark, d).select("doc_id", V.derive_owner(F.col("text"), none, none).alias("o")).select("doc_id", "o.*")


@query("f4_party_block", S.with_(S.FACTS, """SELECT o_orderkey AS doc_id, 'Smt. ' || buyer AS name, 'Flat 12, ' || village || ' Road, Phone:  Village: ' || village AS address, phone
  FROM facts WHERE o_orderkey % 3 = 0"""))
def f4(spark, d):
    party = V.split_party(V.party_block(F.col("text")))
    return L.only(forms(spark, d), "p", party, lambda p: p.isNotNull()).select("doc_id", "p.*")


PARTY_TEXT = ("'This deed is made between Mr. ' || owner || ' S/o Late ' || village || ' Rao aged 50, hereinafter the Vendor. Cell. ' || chr(10) || "
              "'And Smt. ' || buyer || ' W/o ' || owner || ' aged 40, Resident of Flat 3, ' || village || ' Phone ' || phone || ' the Purchaser.'")


def deeds(spark, d):
    return Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), "owner", "buyer", "phone", F.expr(PARTY_TEXT).alias("text"))


@query("f5_party_profiles", S.with_(S.FACTS, "SELECT o_orderkey AS doc_id, 2 AS profiles, 'Smt ' || buyer AS name, phone FROM facts"))
def f5(spark, d):
    x = deeds(spark, d).select("doc_id", "owner", V.party_profiles(F.col("text")).alias("p"))
    return x.select("doc_id", F.size("p").alias("profiles"), V.pick_buyer(F.col("p"), F.col("owner")).alias("b")).select(
        "doc_id", "profiles", "b.name", "b.phone")


@query("f6_party_fallback", S.with_(S.FACTS, f"""SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN buyer ELSE owner END AS name, 0.75::DOUBLE AS name_confidence,
  village AS address, 0.7::DOUBLE AS address_confidence, phone, 0.8::DOUBLE AS phone_confidence FROM facts"""))
def f6(spark, d):
    x = Fm.form_facts(spark, d)
    none = F.lit(None).cast("string")
    return x.select(F.col("o_orderkey").alias("doc_id"), V.party_fallback(
        none, F.when(F.col("o_orderkey") % 2 == 0, F.col("buyer")), F.col("owner"), none, F.col("village"), none, F.expr(PARTY_TEXT)).alias("f")).select("doc_id", "f.*")


TIDY = "regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g')"
_tidy = S.strip(f"regexp_replace(regexp_replace({S.strip(TIDY.format(x='text'))}, '^[:\\-–—=,;\\s]+', ''), '[:\\-–—=,;\\s]+$', '')")


@query("f7_format_pass", f"SELECT conv_id, turn, {_tidy} AS value FROM conversations")
def f7(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", V.tidy(F.col("text")).alias("value"))


CLEAN_KEY = "CASE o_orderkey % 4 WHEN 0 THEN 'purchaser_name' WHEN 1 THEN 'owner_address' WHEN 2 THEN 'property_address' ELSE 'village' END"
CLEAN_VALUE = ("CASE o_orderkey % 4 WHEN 0 THEN 'Mr.  ' || upper(owner) WHEN 1 THEN 'Flat 1' || chr(10) || village || ',, ' || district || ', ' "
               "WHEN 2 THEN 'h no. 12-3,   plot no 5,, ' || village ELSE village END")


@query("f8_field_cleaning", S.with_(S.FACTS, f"""SELECT o_orderkey AS doc_id, {CLEAN_KEY} AS field_key, CASE o_orderkey % 4 WHEN 0 THEN owner WHEN 1 THEN 'Flat 1, ' || village || ', ' || district
  WHEN 2 THEN 'H.No. 12-3, Plot No. 5, ' || village ELSE village END AS value FROM facts"""))
def f8(spark, d):
    x = Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(CLEAN_KEY).alias("field_key"), F.expr(CLEAN_VALUE).alias("v"))
    return x.select("doc_id", "field_key", V.clean_field(F.col("field_key"), F.col("v")).alias("value"))


VAL_KEY = "CASE o_orderkey % 6 WHEN 0 THEN 'inspection_date' WHEN 1 THEN 'pan_number' WHEN 2 THEN 'pincode' WHEN 3 THEN 'cell_number' WHEN 4 THEN 'survey_number' ELSE 'aadhar_number' END"
VAL_VALUE = ("CASE o_orderkey % 6 WHEN 0 THEN CASE WHEN o_orderkey % 18 = 0 THEN '31/31/2020' WHEN o_orderkey % 18 = 6 THEN d_slash ELSE 'on ' || d_dash END "
             "WHEN 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN lower(pan) ELSE substr(pan, 2, 8) END WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN pincode ELSE substr(pincode, 2, 5) END "
             "WHEN 3 THEN CASE WHEN o_orderkey % 4 = 3 THEN '+91 ' || phone ELSE '12345' END WHEN 4 THEN CASE WHEN o_orderkey % 4 = 0 THEN survey ELSE '1' END ELSE phone || '12' END")
VAL_OK = ("CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 18 <> 0 WHEN 1 THEN o_orderkey % 4 = 1 WHEN 2 THEN o_orderkey % 4 = 0 WHEN 3 THEN o_orderkey % 4 = 3 "
          "WHEN 4 THEN o_orderkey % 4 = 0 ELSE true END")


@query("f9_field_validation", S.with_(S.FACTS, f"""SELECT o_orderkey AS doc_id, {VAL_KEY} AS field_key, NOT ({VAL_OK}) AS validation_error,
  CASE WHEN {VAL_OK} THEN 'valid' ELSE 'invalid' END AS validation_status, CASE WHEN {VAL_OK} THEN 0.95 ELSE 0.0 END::DOUBLE AS confidence FROM facts"""))
def f9(spark, d):
    x = Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(VAL_KEY).alias("field_key"), F.expr(VAL_VALUE).alias("value"), F.lit(0.95).alias("confidence"))
    return V.validate(x).select("doc_id", "field_key", "validation_error", "validation_status", "confidence")


CROSS = {"permission_number": "CASE WHEN o_orderkey % 5 = 0 THEN 'P 1' WHEN o_orderkey % 5 = 1 THEN permit || '/' || substr(d_slash, 7, 4) ELSE permit END",
         "built_up_area": "CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE CAST(qty * 10 AS STRING) || ' sft' END", "land_area": "area || ' Sq Yds'",
         "registration_details": "'Registered in 2021'"}
CROSS_SQL = S.FACTS + ",\np AS (SELECT o_orderkey AS doc_id, " + ", ".join(f"{v} AS {k}" for k, v in CROSS.items()) + """, qty FROM facts),
q AS (SELECT *, nullif(regexp_extract(permission_number, '\\b(20\\d{2})\\b', 1), '') AS py,
  CASE WHEN built_up_area <> 'none' THEN CAST(qty * 10 AS DOUBLE) * 0.092903 END AS bm, CAST(qty AS DOUBLE) * 0.836127 AS lm FROM p)"""


@query("f10_cross_field_checks", S.with_(CROSS_SQL, """
SELECT doc_id, 'permission_number' AS field_key, 'invalid' AS status FROM q WHERE permission_number = 'P 1'
UNION ALL SELECT doc_id, 'built_up_area', 'invalid' FROM q WHERE built_up_area = 'none'
UNION ALL SELECT doc_id, 'built_up_area', 'warning' FROM q WHERE bm > lm
UNION ALL SELECT doc_id, 'registration_details', 'warning' FROM q WHERE py <> '2021'
UNION ALL SELECT doc_id, 'permission_number', 'warning' FROM q WHERE py <> '2021'"""))
def f10(spark, d):
    pairs = ", ".join(f"'{k}', {v}" for k, v in CROSS.items())
    rows = Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(f"stack({len(CROSS)}, {pairs}) as (field_key, value)"))
    return V.cross_checks(rows).select("doc_id", "field_key", "status")


COMP = {"plot_number": ("CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS STRING) ELSE '' END", 0.9, 2), "survey_number": ("survey", 0.8, 1), "village": ("village", 1.0, 3)}


@query("f11_composite_field", S.with_(S.FACTS, """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Plot No: ' || CAST(o_orderkey % 40 AS STRING) || ', ' ELSE '' END
  || 'Survey No: ' || survey || ', Village: ' || village AS value, CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS source_page FROM facts"""))
def f11(spark, d):
    pairs = ", ".join(f"'{k}', {v}, {c}D, {p}" for k, (v, c, p) in COMP.items())
    rows = Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(f"stack({len(COMP)}, {pairs}) as (field_key, value, confidence, source_page)"))
    return V.composite(rows, list(COMP)).withColumn("confidence", F.round("confidence", 6))


REQ_KEYS = ["survey_number", "district", "pincode", "transformer_id"]
LABEL_KEYS = {"Survey Number": "survey_number", "District": "district", "PAN No": "pan_number"}


@query("f12_result_rows", S.with_(S.FACTS, """SELECT o_orderkey AS doc_id, k AS field_key, CASE k WHEN 'survey_number' THEN survey WHEN 'district' THEN district END AS value,
  CASE WHEN k IN ('survey_number', 'district') THEN 95 ELSE 0 END AS confidence_pct, CASE WHEN k IN ('survey_number', 'district') THEN 'rule_based' END AS source_method,
  false AS validation_error FROM facts, (VALUES ('survey_number'), ('district'), ('pincode'), ('transformer_id')) t(k)"""))
def f12(spark, d):
    docs = forms(spark, d)
    kv = D.key_values(docs, ["doc_id"])
    key = F.create_map(*[F.lit(x) for p in LABEL_KEYS.items() for x in p])[F.col("label")]
    res = kv.withColumn("field_key", key).filter("field_key is not null").groupBy("doc_id", "field_key").agg(
        F.min_by("value", "source_line").alias("value"), F.max("ocr_confidence").alias("confidence"))
    req = docs.select("doc_id", F.explode(F.array(*[F.lit(k) for k in REQ_KEYS])).alias("field_key"))
    return V.assemble(req, V.validate(res)).select("doc_id", "field_key", "value", "confidence_pct", "source_method", "validation_error")


DEF = rows_sql("defs", "field_key, field_rank, default_value", [(k, i, Dic.MASTER_DEFAULTS.get(k)) for i, k in enumerate(Dic.MASTER_FIELDS)])


@query("f13_master_defaults", S.with_(NAMES + f",\n{ALIASES},\n{DISPLAY},\n{CANON},\n{DEF}", """SELECT n.name, n.canonical_name AS field_key, default_value AS value,
  CASE WHEN default_value IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT name, canonical_name FROM canon UNION ALL SELECT 'c' || c_custkey, 'city' FROM customer) n
  LEFT JOIN defs ON defs.field_key = n.canonical_name"""))
def f13(spark, d):
    from .resolve_queries import names
    n = R.canonical_keys(names(spark, d), Dic.display_names(spark), Dic.aliases(spark)).withColumnRenamed("canonical_name", "field_key")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), F.lit("city").alias("field_key"))
    return V.with_defaults(n.unionByName(c), Dic.master_defaults(spark)).select("name", "field_key", "value", "confidence")


AREA_VALUE = "CASE o_orderkey % 5 WHEN 0 THEN '1,' || CAST(100 + qty AS STRING) || ' Sq Yds' WHEN 1 THEN CAST(qty AS STRING) || '.5 sq mtrs' WHEN 2 THEN CAST(200 + qty AS STRING) || ' sft' WHEN 3 THEN CAST(1000 + qty AS STRING) ELSE CAST(2000 + qty AS STRING) END"
AREA_CTX = "CASE o_orderkey % 5 WHEN 3 THEN 'Extent is ' || CAST(1000 + qty AS STRING) || ' gaj in all' WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'GHMC sheet' ELSE '' END ELSE '' END"


@query("e15_area_conversion", S.with_(S.FACTS, """SELECT doc_id, round(sqft, 2) AS sqft, round(CASE WHEN m IN (0, 3) THEN n ELSE sqft / 9.0::DOUBLE END, 2) AS sqyd FROM (
  SELECT o_orderkey AS doc_id, m, n, CASE WHEN m IN (0, 3) THEN n * 9.0::DOUBLE WHEN m = 1 THEN n * 10.7639::DOUBLE WHEN m = 2 THEN n WHEN o_orderkey % 2 = 0 THEN n * 10.7639::DOUBLE ELSE n END AS sqft FROM (
  SELECT o_orderkey, o_orderkey % 5 AS m, CAST(CASE o_orderkey % 5 WHEN 0 THEN '1' || CAST(100 + qty AS STRING) WHEN 1 THEN CAST(qty AS STRING) || '.5' WHEN 2 THEN CAST(200 + qty AS STRING)
    WHEN 3 THEN CAST(1000 + qty AS STRING) ELSE CAST(2000 + qty AS STRING) END AS DOUBLE) AS n FROM facts))"""))
def e15(spark, d):
    return Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), V.convert_area(F.expr(AREA_VALUE), F.expr(AREA_CTX)).alias("a")).select("doc_id", "a.*")
