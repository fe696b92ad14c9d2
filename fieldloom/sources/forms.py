"""Form documents with known truth, derived from the star schema: one document per order.

The text expression below is plain SQL over the joined row and is shared with the DuckDB checks, so that
both engines see byte-equal documents. Layout, spelling and missing fields vary with the order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import prose_documents, spread, table

FIRST_NAMES = ["Ramesh", "Lakshmi", "Pavan", "Anitha", "Suresh", "Kavitha", "Naveen", "Divya"]
LAST_NAMES = ["Kumar", "Rao", "Reddy", "Sharma", "Naidu", "Varma", "Gupta"]
VILLAGES = ["Bhanoor", "Kokapet", "Narsingi", "Puppalaguda", "Patancheru"]


def _pick(names: list[str], key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {key} % {len(names)} {arms} END"


# truth columns over (o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, n_name, qty, parts)
TRUTH = {
    "owner": f"{_pick(FIRST_NAMES, 'o_custkey')} || ' ' || {_pick(LAST_NAMES, 'o_custkey')}",
    "buyer": f"{_pick(FIRST_NAMES, '(o_custkey + 3)')} || ' ' || {_pick(LAST_NAMES, '(o_custkey + 2)')}",
    "district": "n_name",
    "village": _pick(VILLAGES, "o_custkey"),
    "survey": "CAST(100 + o_custkey % 800 AS STRING) || '/' || chr(65 + CAST(o_custkey % 26 AS INT))",
    "phone": "'9' || lpad(CAST(o_custkey * 7919 % 1000000000 AS STRING), 9, '4')",
    "pan": "'ABCP' || chr(65 + CAST(o_custkey % 26 AS INT)) || lpad(CAST(o_custkey % 10000 AS STRING), 4, '1') || 'K'",
    "pincode": "'50' || lpad(CAST(o_custkey % 10000 AS STRING), 4, '3')",
    "meter": "'EM-' || CAST(9000 + o_orderkey % 977 AS STRING)",
    "permit": "CAST(1 + o_orderkey % 97 AS STRING) || '/C' || CAST(o_orderkey % 31 AS STRING) || '/TP' || "
              "CAST(100 + o_orderkey % 89 AS STRING)",
    "area": "CAST(qty AS STRING)",
    "built": "CAST(400 + qty * 7 AS STRING)",
}

SEP = "CASE o_orderkey % 4 WHEN 0 THEN ': ' WHEN 1 THEN ' : ' WHEN 2 THEN ' - ' ELSE ' = ' END"

# one entry per line; a null line is left out
LINES = [
    "CASE o_orderkey % 6 WHEN 0 THEN 'AGREEMENT OF SALE' WHEN 1 THEN 'BUILDING PERMIT ORDER' "
    "WHEN 2 THEN 'RERA REGISTRATION CERTIFICATE' WHEN 3 THEN 'WORK ORDER' WHEN 4 THEN '## Sale deed' "
    "ELSE 'VALUATION NOTE' END",
    "''",
    "'This paper is dated ' || d_dash || '.'",
    "CASE WHEN o_orderkey % 7 = 6 THEN NULL WHEN o_orderkey % 5 = 3 THEN 'Owner Name' "
    f"WHEN o_orderkey % 11 = 5 THEN 'Ownar Name' || {SEP} || owner ELSE 'Owner Name' || {SEP} || 'Mr. ' || owner END",
    "CASE WHEN o_orderkey % 7 <> 6 AND o_orderkey % 5 = 3 THEN owner END",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'Name of the Purchaser: Smt. ' || buyer || ', Flat 12, ' || village || ' Road, Phone: ' || phone END",
    "'Village: ' || village",
    f"'District' || {SEP} || district",
    "''",
    "'PROPERTY DETAILS'",
    f"'Survey Number' || {SEP} || survey",
    "CASE WHEN o_orderkey % 4 = 1 THEN 'Inspection Date: ' || d_slash ELSE 'Date of Inspection: ' || d_slash END",
    "'Land Area: ' || area || ' Sq Yds'",
    "'Built-up Area: ' || built || ' sft'",
    "CASE WHEN o_orderkey % 9 = 4 THEN 'PAM Numbir - ' || pan ELSE 'PAN No: ' || pan END",
    "'Priority code  ' || o_orderpriority || '  ' || c_mktsegment",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'PERMIT No. ' || permit ELSE 'Vide File No. ' || permit || ' of ' || d_dash END",
    "''",
    "'Schedule information:'",
    "'| Item | Value |'",
    "'| --- | --- |'",
    "'| Order | ' || CAST(o_orderkey AS STRING) || ' |'",
    "'| Pincode | ' || pincode || ' |'",
    "''",
    "'North: Plot ' || CAST(1 + o_orderkey % 40 AS STRING)",
    "'Bounded on the South by: Open to sky'",
    "'East side - ' || CAST(20 + o_orderkey % 3 * 10 AS STRING) || ' Feet Wide Road'",
    "CASE WHEN o_orderkey % 8 <> 1 THEN 'West: Corridor' END",
    "''",
    "'Property Description:'",
    "'Residential flat on floor ' || CAST(1 + o_orderkey % 5 AS STRING) || ' of the ' || lower(c_mktsegment) || ' block,'",
    "'with one covered parking'",
    "'The property belongs to ' || owner || ' residing at ' || village || ', near the temple.'",
    "'Electric Meter Number ' || meter || ' is installed in the premises.'",
    "CASE WHEN o_orderkey % 10 = 7 THEN 'The plot is under mortgage and a court case is pending.' END",
    "CASE WHEN o_orderkey % 12 = 5 THEN 'This is a leasehold site near a water body.' END",
]

TEXT = "concat_ws(chr(10), " + ", ".join(LINES) + ")"

FILE_NAME = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'AOS_' WHEN 1 THEN 'permit ' WHEN 2 THEN 'RERA-' WHEN 3 THEN 'Work Order ' "
    "WHEN 4 THEN 'scan_' ELSE 'note.' END || CAST(o_orderkey % 4 AS STRING) || "
    "CASE WHEN o_orderkey % 2 = 0 THEN '.txt' ELSE '.TXT' END"
)


def form_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, customer, nation and line-item facts of every form, with the truth columns."""
    orders = spread(
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").cast("int").alias("items_qty"))
    )
    base = (
        orders.join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .withColumn("qty", F.coalesce("items_qty", F.lit(0)))
        .withColumn("d_slash", F.date_format("o_orderdate", "dd/MM/yyyy"))
        .withColumn("d_dash", F.date_format("o_orderdate", "dd-MM-yyyy"))
    )
    return base.withColumns({k: F.expr(v) for k, v in TRUTH.items()})


def form_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, case_id, file_name, text)``, one row per order."""
    return form_facts(spark, sf_dir).select(
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_custkey").alias("case_id"),
        F.expr(FILE_NAME).alias("file_name"),
        F.expr(TEXT).alias("text"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and prose in one corpus ``(corpus, doc_id, text)``."""
    forms = form_documents(spark, sf_dir).select(F.lit("form").alias("corpus"), "doc_id", "text")
    prose = prose_documents(spark, sf_dir).select(F.lit("prose").alias("corpus"), "doc_id", "text")
    return forms.unionByName(prose)
