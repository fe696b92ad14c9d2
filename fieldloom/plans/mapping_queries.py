"""Registered queries of classification, templates, mapping and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import templates as G
from ..sources import forms as Fm
from ..sources.tables import table
from . import sqlkit as S
from .queries_base import collector

QUERIES, ORACLES, query = collector()


def any_of(col, words):
    return "(" + " OR ".join(f"contains({col}, {S.lit(w)})" for w in words) + ")"


CLASS = ("CASE " + " ".join(f"WHEN {any_of('upper(file_name)', w)} THEN '{c}'" for c, w in G.NAME_CLASSES)
         + " " + " ".join(f"WHEN {any_of('upper(text)', w)} THEN '{c}'" for c, w in G.CONTENT_CLASSES)
         + " " + " ".join("WHEN " + " AND ".join(f"contains(upper(text), {S.lit(x)})" for x in w) + f" THEN '{c}'" for c, w in G.WEAK_CLASSES) + " END")
CLASSED = S.FORMS + f",\nclassed AS (SELECT *, {CLASS} AS doc_type FROM forms)"


def classed(spark, d):
    return Fm.form_documents(spark, d).withColumn("doc_type", G.classify_document(F.col("file_name"), F.col("text")))


@query("g1_classify", S.with_(CLASSED, "SELECT doc_id, file_name, doc_type FROM classed"))
def g1(spark, d):
    return classed(spark, d).select("doc_id", "file_name", "doc_type")


@query("g1_classify_prose", f"SELECT doc_id, {CLASS} AS doc_type FROM (SELECT doc_id, source AS file_name, text FROM documents)")
def g1b(spark, d):
    return table(spark, d, "documents").select("doc_id", G.classify_document(F.col("source"), F.col("text")).alias("doc_type"))


@query("g2_bundle_by_type", S.with_(CLASSED, """SELECT case_id, doc_type, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5
  FROM classed WHERE doc_type IS NOT NULL GROUP BY 1, 2"""))
def g2(spark, d):
    return G.bundle_texts(classed(spark, d)).select("case_id", "doc_type", F.md5("text").alias("text_md5"))


@query("h5_class_sizes", S.with_(CLASSED, "SELECT case_id, doc_type, CAST(sum(length(text)) + 2 * (count(*) - 1) AS BIGINT) AS chars FROM classed WHERE doc_type IS NOT NULL GROUP BY 1, 2"))
def h5(spark, d):
    return G.class_sizes(classed(spark, d))


# template rows derived from parts: the template is the brand, the label varies with the key
LABEL = ("CASE p_partkey % 9 WHEN 0 THEN 'SECTION ' || p_type WHEN 1 THEN 'IV. ' || p_type WHEN 2 THEN 'Remarks on ' || p_name "
         "WHEN 3 THEN '' WHEN 4 THEN 'Risk of ' || p_type ELSE p_name END")
RIGHT = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{{' || p_name || '}}' WHEN 2 THEN p_name ELSE p_type || ' value' END"
ROWS = f"trows AS (SELECT p_brand AS template_id, p_partkey AS row_no, {LABEL} AS label, {RIGHT} AS \"right\" FROM part)"
TYPE = lambda c: (f"CASE WHEN starts_with(upper({c}), 'SECTION') OR regexp_matches(upper({c}), {S.lit(G.ROMAN_HEADING)}) THEN 'SECTION' "  # noqa: E731
                  f"WHEN {any_of(f'lower({c})', G.MANUAL_WORDS)} THEN 'MANUAL' ELSE 'AUTO' END")
FIELDS = ROWS + f""",
tfirst AS (SELECT template_id, label AS field_name, min(row_no) AS row_no, arg_min("right", row_no) AS r FROM trows WHERE label <> '' AND label <> "right" GROUP BY 1, 2),
tfields AS (SELECT template_id, field_name, {TYPE('field_name')} AS field_type,
  CASE WHEN r <> '' AND NOT contains(r, '{{') AND NOT contains(r, '}}') THEN r END AS static_value,
  row_number() OVER (PARTITION BY template_id ORDER BY row_no) AS display_order FROM tfirst)"""


def trows(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("template_id"), F.col("p_partkey").alias("row_no"),
                                          F.expr(LABEL).alias("label"), F.expr(RIGHT).alias("right"))


def tfields(spark, d):
    return G.fields_from_rows(trows(spark, d))


@query("g3_field_types", f"WITH {ROWS} SELECT label, {TYPE('label')} AS field_type, count(*) AS n FROM trows GROUP BY 1, 2")
def g3(spark, d):
    return trows(spark, d).groupBy("label", G.field_type(F.col("label")).alias("field_type")).agg(F.count("*").alias("n"))


@query("g4_table_fields", f"WITH {FIELDS} SELECT * FROM tfields")
def g4(spark, d):
    return tfields(spark, d)


META = "(" + ", ".join(S.lit(k) for ks in G.METADATA_KEYS.values() for k in ks) + ")"


@query("g5_template_lines", S.with_(S.FORM_LINES + f""",
g0 AS (SELECT doc_id, line_no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM flines),
g1 AS (SELECT *, trim(regexp_extract(text, '^([^:=]+)[:=](.+)$', 1)) AS k, trim(regexp_extract(text, '^([^:=]+)[:=](.+)$', 2)) AS v FROM g0),
g2 AS (SELECT *, CASE WHEN text = '' THEN 'blank' WHEN len(string_split(text, ' ')) <= 8 AND upper(text) = text AND lower(text) <> text THEN 'heading'
  WHEN k <> '' AND lower(k) IN {META} THEN 'metadata' WHEN k <> '' OR ends_with(text, ':') THEN 'field' ELSE 'other' END AS kind FROM g1),
g3 AS (SELECT *, kind = 'field' OR (kind IN ('metadata', 'other') AND coalesce(lag(kind) OVER w, 'blank') IN ('blank', 'heading')) AS opens FROM g2 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g4 AS (SELECT *, CAST(sum(CAST(kind = 'heading' AS INT)) OVER w AS BIGINT) AS section_no, sum(CAST(opens AS INT)) OVER w AS field_no,
  coalesce(last_value(CASE WHEN kind = 'heading' THEN upper(text) END IGNORE NULLS) OVER w, 'GENERAL') AS section FROM g3 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
g5 AS (SELECT doc_id, section_no, section, field_no, max(CASE WHEN opens THEN CASE WHEN k <> '' THEN k ELSE text END END) AS label,
  max(CASE WHEN opens AND k <> '' THEN v END) AS static_value, string_agg(CASE WHEN opens OR kind = 'other' THEN text END, chr(10) ORDER BY line_no) AS raw_text
  FROM g4 WHERE kind IN ('field', 'metadata', 'other') GROUP BY 1, 2, 3, 4)""",
    f"""SELECT doc_id, section_no, section, field_no, label, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') AS field_code,
  static_value, raw_text, {TYPE('label')} AS field_type FROM g5"""))
def g5(spark, d):
    return G.parse_specs(Fm.form_documents(spark, d).select("doc_id", "text")).select("doc_id", "section_no", "section", "field_no", "label", "field_code", "static_value", "raw_text", "field_type")


@query("g6_flatten_spec", """SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS depth,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS STRING) || CASE WHEN l_returnflag = 'N' THEN '' ELSE '/0' END AS path,
  CASE WHEN l_returnflag = 'N' THEN 'line ' || l_linenumber ELSE 'part ' || l_partkey END AS label FROM lineitem""")
def g6(spark, d):
    li = table(spark, d, "lineitem")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag")))
    nested = lambda x: F.when(x["l_returnflag"] != "N", F.array(F.struct(F.concat(F.lit("part "), x["l_partkey"]).alias("label"))))
    fields = F.transform(ordered, lambda x: F.struct(F.concat(F.lit("line "), x["l_linenumber"]).alias("label"), nested(x).alias("nested_fields")))
    specs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(fields.alias("fields"))
    return G.flatten_spec(specs, ["doc_id"]).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


@query("g7_required_fields", f"WITH {FIELDS} SELECT template_id, field_name, display_order FROM tfields WHERE field_type = 'AUTO'")
def g7(spark, d):
    return G.required_fields(tfields(spark, d))


RES = ("SELECT o_custkey AS case_id, l_orderkey AS doc_id, 'field_' || CAST(l_linenumber AS STRING) AS canonical_name, "
       "CASE WHEN l_tax < 0.02 THEN '' ELSE CAST(l_partkey AS STRING) END AS value, 100.0 - 500 * l_discount AS confidence "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey")


def case_results(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    li = table(spark, d, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "case_id", F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("canonical_name"),
        F.expr("CASE WHEN l_tax < 0.02 THEN '' ELSE CAST(l_partkey AS STRING) END").alias("value"), F.expr("100.0D - 500 * l_discount").alias("confidence"))


BEST = f"""best AS (SELECT case_id, canonical_name, value, confidence, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY case_id, canonical_name ORDER BY confidence DESC, doc_id, value DESC) AS rn
  FROM ({RES}) WHERE value <> '') WHERE rn = 1)"""


@query("g8_best_value", f"WITH {BEST} SELECT case_id, canonical_name, value, round(confidence, 6) AS confidence, doc_id FROM best")
def g8(spark, d):
    return G.best_values(case_results(spark, d), ["case_id", "canonical_name"]).withColumn("confidence", F.round("confidence", 6))


# eight template fields per case: the name follows the canonical key only for the even ones
TEMPLATE = [(f"Field {i}", f"field_{i}" if i % 2 == 0 else f"other_{i}", f"field_{i}" if i % 3 else f"unknown_{i}",
             "SECTION" if i == 5 else "MANUAL" if i == 7 else "AUTO") for i in range(1, 9)]


def case_fields(spark, d):
    t = F.array(*[F.struct(F.lit(a).alias("field_name"), F.lit(b).alias("field_code"), F.lit(c).alias("canonical_name"), F.lit(e).alias("field_type")) for a, b, c, e in TEMPLATE])
    return table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.explode(t).alias("t")).select("case_id", "t.*")


TSQL = "tpl(field_name, field_code, canonical_name, field_type) AS (VALUES " + ", ".join(str(t) for t in TEMPLATE) + ")"
MAPPED = f"""{BEST}, {TSQL},
m0 AS (SELECT c_custkey AS case_id, t.*, coalesce(a.value, b.value) AS v, CASE WHEN a.value IS NOT NULL THEN a.confidence ELSE b.confidence END / 100.0 AS c
  FROM customer CROSS JOIN tpl t LEFT JOIN best a ON a.case_id = c_custkey AND a.canonical_name = t.canonical_name
  LEFT JOIN best b ON b.case_id = c_custkey AND b.canonical_name = t.field_code),
m AS (SELECT case_id, field_name, field_type, CASE WHEN field_type = 'AUTO' THEN v ELSE '' END AS extracted_value,
  CASE WHEN field_type = 'AUTO' AND v IS NOT NULL THEN round(c, 6) END AS confidence, field_type = 'AUTO' AND (v IS NULL OR c < 0.7) AS needs_review,
  field_type = 'AUTO' AND v IS NULL AS open FROM m0)"""


def mapped(spark, d):
    return G.map_template(case_fields(spark, d), G.best_values(case_results(spark, d), ["case_id", "canonical_name"]))


@query("g9_template_mapping", f"WITH {MAPPED} SELECT * FROM m")
def g9(spark, d):
    return mapped(spark, d).drop("field_code").withColumn("confidence", F.round("confidence", 6))


@query("g9_mapping_coverage", f"""WITH {MAPPED} SELECT case_id, count(*) AS total_fields, count(*) FILTER (WHERE extracted_value <> '') AS filled_fields FROM m GROUP BY 1""")
def g9b(spark, d):
    return A.coverage(mapped(spark, d).withColumnRenamed("extracted_value", "value"), ["case_id"])


SAVED = ("SELECT l_orderkey AS doc_id, CASE l_linenumber % 3 WHEN 0 THEN 'field_' || l_linenumber WHEN 1 THEN 'Field ' || l_linenumber ELSE 'other_' || l_linenumber END AS name, "
         "max(CAST(l_suppkey AS STRING)) AS value FROM lineitem GROUP BY 1, 2")


@query("g10_map_saved", f"""WITH s AS ({SAVED}), {TSQL}, d AS (SELECT DISTINCT doc_id FROM s),
j AS (SELECT d.doc_id, t.*, coalesce(a.value, b.value, c.value) AS v FROM d CROSS JOIN tpl t
  LEFT JOIN s a ON a.doc_id = d.doc_id AND a.name = t.field_code LEFT JOIN s b ON b.doc_id = d.doc_id AND b.name = t.canonical_name
  LEFT JOIN s c ON c.doc_id = d.doc_id AND c.name = t.field_name)
SELECT doc_id, field_name AS label, field_code, field_type, CASE WHEN field_type = 'SECTION' THEN '' ELSE coalesce(v, '') END AS extracted_value,
  CASE WHEN field_type = 'AUTO' THEN CASE WHEN v IS NULL THEN 0.0 ELSE 1.0 END END AS confidence, field_type = 'AUTO' AND v IS NULL AS needs_review FROM j""")
def g10(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.expr(
        "CASE l_linenumber % 3 WHEN 0 THEN 'field_' || l_linenumber WHEN 1 THEN 'Field ' || l_linenumber ELSE 'other_' || l_linenumber END").alias("name")).agg(
        F.max(F.col("l_suppkey").cast("string")).alias("value"))
    t = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("field_code"), F.lit(c).alias("canonical_name"), F.lit(e).alias("field_type")) for a, b, c, e in TEMPLATE])
    f = s.select("doc_id").distinct().select("doc_id", F.explode(t).alias("t")).select("doc_id", "t.*")
    return G.map_saved(f, s)


STORED = ("SELECT l_orderkey AS doc_id, 'field_' || l_linenumber AS canonical_name, 'Field ' || l_linenumber AS field_name, max(CAST(l_partkey AS STRING)) AS value, "
          "CAST(max(l_quantity) AS INT) AS confidence FROM lineitem GROUP BY 1, 2, 3")
SENT = "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'field_1' ELSE 'extra_note' END AS canonical_name, o_orderpriority AS value FROM orders"


@query("g11_correction_merge", f"""WITH s AS ({STORED}), c AS ({SENT})
SELECT coalesce(s.doc_id, c.doc_id) AS doc_id, coalesce(s.canonical_name, c.canonical_name) AS canonical_name,
  coalesce(s.field_name, array_to_string(list_transform(string_split(c.canonical_name, '_'), lambda w: upper(w[1]) || w[2:]), ' ')) AS field_name,
  CASE WHEN c.doc_id IS NOT NULL THEN c.value ELSE s.value END AS value, CASE WHEN s.doc_id IS NULL THEN 100 ELSE s.confidence END AS confidence
FROM s FULL JOIN c ON s.doc_id = c.doc_id AND s.canonical_name = c.canonical_name""")
def g11(spark, d):
    st = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), F.expr("'field_' || l_linenumber").alias("canonical_name"), F.expr("'Field ' || l_linenumber").alias("field_name")).agg(
        F.max(F.col("l_partkey").cast("string")).alias("value"), F.max("l_quantity").cast("int").alias("confidence"))
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(
        "CASE WHEN o_orderkey % 2 = 0 THEN 'field_1' ELSE 'extra_note' END").alias("canonical_name"), F.col("o_orderpriority").alias("value"))
    return A.correct_values(st, c)


# report values per document: five template slots, values from the form facts
SLOTS = [(0, "owner_code", "Owner Name", "", ""), (1, "pin", "Pin Code", "pincode", "000000"), (2, "extra", "Extra Field", "", "n/a"),
         (3, "survey", "Survey No.", "", ""), (4, "empty", "Nothing", "", "")]
VALUE_COLS = {"owner_name": "owner", "pincode": "pincode", "survey": "survey", "Owner Name": "CASE WHEN o_orderkey % 2 = 0 THEN owner ELSE '' END"}
VAL_SQL = "vals AS (" + " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{k}' AS name, {v} AS value FROM facts" for k, v in VALUE_COLS.items()) + ")"
SLOT_SQL = "slots(ord, field_code, label, dynamic_value, static_value) AS (VALUES " + ", ".join(str(x) for x in SLOTS) + ")"


def slots(spark, d):
    s = F.array(*[F.struct(F.lit(a).alias("ord"), F.lit(b).alias("field_code"), F.lit(c).alias("label"), F.lit(e).alias("dynamic_value"), F.lit(f).alias("static_value")) for a, b, c, e, f in SLOTS])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(s).alias("s")).select("doc_id", "s.*")


def values(spark, d):
    pairs = ", ".join(f"'{k}', {v}" for k, v in VALUE_COLS.items())
    return Fm.form_facts(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.expr(f"stack({len(VALUE_COLS)}, {pairs}) as (name, value)"))


_slug = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"


@query("g12_report_values", S.with_(S.FACTS + f", {VAL_SQL}, {SLOT_SQL}" + f""",
v AS (SELECT * FROM vals WHERE value <> ''),
w AS (SELECT o_orderkey AS doc_id, ord, label, field_code, static_value, unnest([field_code, label, {_slug('label')}, dynamic_value]) AS name, unnest([0, 1, 2, 3]) AS pos FROM orders CROSS JOIN slots),
f AS (SELECT w.doc_id, ord, arg_min(value, pos) AS chosen FROM w JOIN v ON v.doc_id = w.doc_id AND v.name = w.name GROUP BY 1, 2),
n AS (SELECT o.o_orderkey AS doc_id, s.ord, s.field_code, s.label, coalesce(chosen, nullif(static_value, '')) AS value FROM orders o CROSS JOIN slots s LEFT JOIN f ON f.doc_id = o.o_orderkey AND f.ord = s.ord),
u AS (SELECT doc_id, ord, unnest([field_code, label, {_slug('label')}]) AS name, value FROM n WHERE value IS NOT NULL UNION ALL SELECT doc_id, 1000000, name, value FROM v)""",
    "SELECT doc_id, name, arg_max(value, ord) AS value FROM u WHERE name <> '' GROUP BY 1, 2"))
def g12(spark, d):
    return G.report_values(slots(spark, d), values(spark, d))


CERT = ("This is {{owner}}, of {{village}} Village. Survey {{survey}} [survey] <area> {area}, pin {{pincode}}. "
        "Seen on {{inspection_date}}; {{survey number}} stays open.")
TOKENS = {"owner": "owner", "village": "village", "survey": "survey", "pincode": "pincode", "area": "area", "inspection_date": "d_slash"}


def certificates(spark, d, spellings=(("{{", "}}"),)):
    facts = Fm.form_facts(spark, d)
    vals = F.array(*[F.struct(F.lit(k).alias("name"), F.col(c).alias("value")) for k, c in TOKENS.items()])
    return facts.select(F.col("o_orderkey").alias("doc_id"), G.render(F.concat(F.lit(CERT), F.lit(" "), F.col("c_mktsegment")), vals, spellings).alias("text"))


def _render_sql(spellings):
    x = f"{S.lit(CERT)} || ' ' || c_mktsegment"
    for k in sorted(TOKENS, key=lambda k: (-len(k), k)):
        for a, b in spellings:
            x = f"replace({x}, {S.lit(a + k + b)}, {TOKENS[k]})"
    return x


@query("g13_mail_merge", S.with_(S.FACTS, f"SELECT o_orderkey AS doc_id, {_render_sql([('{{', '}}')])} AS text FROM facts"))
def g13(spark, d):
    return certificates(spark, d)


@query("g14_unresolved_tokens", S.with_(S.FACTS + f", c AS (SELECT o_orderkey AS doc_id, {_render_sql([('{{', '}}')])} AS text FROM facts)",
       "SELECT DISTINCT doc_id, trim(t) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\{\\{([a-zA-Z0-9_\\s]+)\\}\\}', 1)) AS t FROM c)"))
def g14(spark, d):
    return G.unresolved_tokens(certificates(spark, d))


@query("g15_structure_compare", S.with_(S.FORMS, """SELECT doc_id, 1 AS tables_lost FROM forms WHERE contains(text, '  ')"""))
def g15(spark, d):
    before = Fm.form_documents(spark, d).select("doc_id", "text")
    after = before.withColumn("text", F.regexp_replace("text", "[ \t]+", " "))
    return G.structure_mismatch(before, after).select("doc_id", (F.col("tables") - F.col("tables_after")).cast("int").alias("tables_lost"))


@query("g16_known_tokens", f"""WITH {ROWS} SELECT DISTINCT token FROM (SELECT lower(template_id) AS token FROM trows UNION SELECT label FROM trows
  UNION SELECT {_slug('label')} FROM trows UNION SELECT "right" FROM trows UNION SELECT s_name FROM supplier) WHERE token <> '' AND token NOT IN ('HEADER', 'header')""")
def g16(spark, d):
    f = trows(spark, d).select(F.lower("template_id").alias("field_code"), "label", F.col("right").alias("dynamic_value"))
    return G.known_tokens(f, table(spark, d, "supplier").select(F.col("s_name").alias("name")))


@query("g17_token_spellings", S.with_(S.FACTS, f"SELECT o_orderkey AS doc_id, {_render_sql(G.ALL_SPELLINGS)} AS text FROM facts"))
def g17(spark, d):
    return certificates(spark, d, G.ALL_SPELLINGS)


@query("g18_template_refresh", f"""WITH {FIELDS}, fresh AS (SELECT 'Brand#' || s_nationkey AS template_id, s_name AS field_name, 'AUTO' AS field_type, NULL AS static_value, s_suppkey AS display_order FROM supplier)
SELECT template_id, field_name FROM tfields WHERE template_id NOT IN (SELECT template_id FROM fresh) UNION ALL SELECT template_id, field_name FROM fresh""")
def g18(spark, d):
    fresh = table(spark, d, "supplier").select(
        F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string")).alias("template_id"), F.col("s_name").alias("field_name"), F.lit("AUTO").alias("field_type"),
        F.lit(None).cast("string").alias("static_value"), F.col("s_suppkey").cast("int").alias("display_order"))
    return G.refresh_fields(tfields(spark, d), fresh).select("template_id", "field_name")


@query("g19_slug_collisions", f"""WITH {ROWS}, s AS (SELECT DISTINCT label || CASE WHEN row_no % 2 = 0 THEN '!' ELSE ' ' END AS name FROM trows)
SELECT coalesce(nullif({_slug('name')}, ''), 'field') AS slug, count(*) AS names, min(name) AS first_name FROM s GROUP BY 1 HAVING count(*) > 1""")
def g19(spark, d):
    n = trows(spark, d).select(F.concat("label", F.when(F.col("row_no") % 2 == 0, "!").otherwise(" ")).alias("name")).distinct()
    return G.slug_collisions(n)
