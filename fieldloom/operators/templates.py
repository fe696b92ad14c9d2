"""Templates and mapping: classification, field lists, mapping of values, text rendering and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from . import discovery as D

# ---- fixed values -------------------------------------------------------------------------
NAME_CLASSES = [
    ("AOS", ["AOS", "AGREEMENT OF SALE", "AGREEMENT FOR SALE"]),
    ("PERMISSION", ["PERMISSION", "PERMIT", "GHMC"]),
    ("RERA", ["RERA"]),
    ("WO", ["WORK ORDER", "WO", "WORKORDER"]),
    ("SALE_DEED", ["SALE DEED", "DEED OF SALE", "DAGPA"]),
]
CONTENT_CLASSES = [
    ("AOS", ["VENDEE", "AGREEMENT OF SALE", "AGREEMENT FOR SALE", "PURCHASER", "SECOND PART"]),
    ("PERMISSION", ["PERMIT NO", "GHMC", "BUILDING PERMISSION", "FILE NO", "COMMISSIONER"]),
    ("RERA", ["RERA REGISTRATION NUMBER", "RERA REG", "RERA NO", "RERA REGISTRATION"]),
    ("WO", ["WORK ORDER", "PLACED ON", "WO NO", "PURCHASE ORDER"]),
    ("SALE_DEED", ["SALE DEED", "DEED OF SALE", "DAGPA"]),
]
# every word of the list must occur
WEAK_CLASSES = [("RERA", ["RERA"]), ("AOS", ["AGREEMENT"]), ("PERMISSION", ["PERMIT"]), ("WO", ["WORK", "ORDER"]), ("SALE_DEED", ["DEED"])]
ROMAN_HEADING = r"^(I|II|III|IV|V|VI|VII|VIII|IX|X)(\.?\s+|\.?$)"
MANUAL_WORDS = ["guideline value", "fair market value", "distress value", "realizable value", "remarks", "risk", "valuer",
                "marketability", "recommendation"]
METADATA_KEYS = {
    "document_source": ["source document", "document source", "source"],
    "keywords": ["keywords"],
    "static_value": ["static value", "static"],
    "dynamic_value": ["dynamic value", "dynamic"],
    "field_type": ["field type", "type"],
    "label": ["label", "field label"],
    "field_code": ["field code", "code"],
}
RESERVED_TOKENS = ["HEADER", "HEADER_IMAGE", "header", "header_image", "HEADER_LOGO", "header_logo"]
KEY_VALUE_LINE = r"^([^:=]+)[:=](.+)$"
REVIEW_BELOW = 0.7
# -------------------------------------------------------------------------------------------


def classify_document(file_name: Column, text: Column) -> Column:
    """Document class by file name, then content words, then weak words; null otherwise."""
    def decide(x: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for cls, words in NAME_CLASSES:
            out = out.when(T.contains_any(x["name"], words), cls)
        for cls, words in CONTENT_CLASSES:
            out = out.when(T.contains_any(x["body"], words), cls)
        for cls, words in WEAK_CLASSES:
            cond = F.lit(True)
            for w in words:
                cond = cond & x["body"].contains(w)
            out = out.when(cond, cls)
        return out

    return T.let(F.struct(F.upper(file_name).alias("name"), F.upper(text).alias("body")), decide)


def bundle_texts(docs: DataFrame, by: Sequence[str] = ("case_id", "doc_type")) -> DataFrame:
    """Texts of one case and class joined in input order by a blank line (one value per case and class)."""
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return docs.filter(F.col("doc_type").isNotNull()).groupBy(*by).agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def class_sizes(docs: DataFrame, by: Sequence[str] = ("case_id", "doc_type")) -> DataFrame:
    """Characters per class as they would be after joining, without joining."""
    return docs.filter(F.col("doc_type").isNotNull()).groupBy(*by).agg(
        (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"))


def field_type(name: Column) -> Column:
    n = T.strip(name)
    return (
        F.when(F.upper(n).startswith("SECTION") | F.upper(n).rlike(ROMAN_HEADING), "SECTION")
        .when(T.contains_any(F.lower(n), MANUAL_WORDS), "MANUAL").otherwise("AUTO")
    )


def fields_from_rows(rows: DataFrame) -> DataFrame:
    """Table rows ``(template_id, row_no, label, right)`` to the template's field list, first row per label."""
    lab, right = T.strip(F.col("label")), T.strip(F.col("right"))
    kept = rows.select("template_id", "row_no", lab.alias("field_name"), right.alias("right")).filter(
        (F.col("field_name") != "") & (F.col("field_name") != F.col("right")))
    first = kept.groupBy("template_id", "field_name").agg(F.min(F.struct("row_no", "right")).alias("f"))
    dynamic = (F.col("f.right") == "") | F.col("f.right").contains("{") | F.col("f.right").contains("}")
    # a template's field list is small, so its order is a window per template
    order = Window.partitionBy("template_id").orderBy("f.row_no")
    return first.select(
        "template_id", "field_name", field_type(F.col("field_name")).alias("field_type"),
        F.when(~dynamic, F.col("f.right")).alias("static_value"), F.row_number().over(order).alias("display_order"))


def line_kind(t: Column) -> Column:
    metadata = [k for ks in METADATA_KEYS.values() for k in ks]
    # no key: not a ``key: value`` line
    return T.let(F.lower(T.collapse_blanks(F.regexp_extract(t, KEY_VALUE_LINE, 1))), lambda key: (
        F.when(t == "", "blank").when((F.size(F.split(t, " ")) <= 8) & T.is_upper(t), "heading")
        .when((key != "") & key.isin(metadata), "metadata").when((key != "") | t.endswith(":"), "field").otherwise("other")))


def _spec_fields(items: Column) -> Column:
    """Classified lines ``<text, kind>`` of one template to its fields in order: ``<section_no, section, lines>``, the opening line first.

    A field's lines end before the next line that opens a field, is blank or is a heading; whatever follows those opens a field itself.
    """
    def marked(x: Column, i: Column) -> Column:
        prev = F.coalesce(F.get(items, i - 1)["kind"], F.lit("blank"))
        opens = (x["kind"] == "field") | (x["kind"].isin("metadata", "other") & prev.isin("blank", "heading"))
        return F.struct(x["text"].alias("text"), x["kind"].alias("kind"), opens.alias("opens"))

    def cut(ms: Column) -> Column:
        starts = F.array_compact(F.transform(ms, lambda m, i: F.when(m["opens"] | m["kind"].isin("heading", "blank"), F.struct(
            i.alias("i"), m["opens"].alias("opens"), F.when(m["kind"] == "heading", F.upper(m["text"])).alias("title")))))
        return T.let(starts, lambda ss: T.let(F.array_compact(F.transform(ss, lambda x, j: F.when(x["title"].isNotNull(), j))), lambda heads: F.flatten(
            F.transform(F.sequence(F.lit(0), F.size(heads)), lambda k: section(ms, ss, heads, k)))))

    def section(ms: Column, ss: Column, heads: Column, k: Column) -> Column:
        def fields(at: Column) -> Column:
            name = F.when(k > 0, F.get(ss, at["low"])["title"]).otherwise("GENERAL")
            own = F.transform(F.slice(ss, at["low"] + 1, at["high"] - at["low"]), lambda x, j: F.when(x["opens"], F.struct(
                k.cast("long").alias("section_no"), name.alias("section"),
                F.slice(ms, x["i"] + 1, F.coalesce(F.get(ss, at["low"] + j + 1)["i"], F.size(ms)) - x["i"]).alias("lines"))))
            return F.array_compact(own)

        return T.let(F.struct(F.coalesce(F.get(heads, k - 1), F.lit(0)).alias("low"), F.coalesce(F.get(heads, k), F.size(ss)).alias("high")), fields)

    return T.let(F.transform(items, marked), cut)


def parse_specs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Templates ``(key, text)`` to the fields of ``parse_spec_lines``, each within its template's row: no line is exchanged or sorted."""
    lines = F.transform(T.split_lines(F.col("text")), T.collapse_blanks)
    items = T.let(lines, lambda ls: F.transform(ls, lambda t: F.struct(t.alias("text"), line_kind(t).alias("kind"))))
    d = docs.select(key, F.posexplode_outer(T.let(items, _spec_fields)).alias("pos", "f")).filter(F.col("pos").isNotNull())
    part = lambda text, n: T.collapse_blanks(F.regexp_extract(text, KEY_VALUE_LINE, n))
    metas = F.transform(F.filter("f.lines", lambda x: ~x["opens"] & (x["kind"] == "metadata")), lambda x: F.struct(F.lower(part(x["text"], 1)).alias("k"), part(x["text"], 2).alias("v")))
    d = d.select(key, (F.col("pos") + 1).cast("long").alias("field_no"), "f.section_no", "f.section", F.get("f.lines", F.lit(0))["text"].alias("first"), metas.alias("metas"),
                 F.array_join(F.transform(F.filter("f.lines", lambda x: x["opens"] | (x["kind"] == "other")), lambda x: x["text"]), "\n").alias("raw_text"))
    d = d.withColumns({"k": part(F.col("first"), 1), "v": part(F.col("first"), 2)})
    last_meta = lambda name: F.get(F.reverse(F.filter("metas", lambda m: m["k"].isin(METADATA_KEYS[name]))), F.lit(0))["v"]
    source = lambda v: F.upper(F.substring_index(v, ".", 1))
    sourced, label0 = F.lower("k").isin("source document", "document source"), F.when(F.col("k") != "", F.col("k")).otherwise(F.col("first"))
    d = d.select(
        key, "section_no", "section", "field_no", F.coalesce(last_meta("label"), label0).alias("label"),
        F.coalesce(F.nullif(F.coalesce(T.slug(last_meta("field_code")), T.slug(label0)), F.lit("")), F.lit("field")).alias("field_code"),
        F.coalesce(source(last_meta("document_source")), F.when(sourced, source(F.col("v")))).alias("document_source"),
        F.coalesce(last_meta("static_value"), F.when((F.col("k") != "") & ~sourced & (F.lower("k") != "keywords"), F.col("v"))).alias("static_value"), "raw_text")
    return d.withColumn("field_type", field_type(F.col("label")))


def parse_spec_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Template lines ``(key, line_no, text)`` to fields: section, label, code, source, static value, raw text.

    A line opens a field when it is a ``key: value`` line, or when it follows a blank line or a heading; the lines
    after it belong to it. Sections and fields are running counts within the template.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    d = lines.withColumn("text", T.collapse_blanks(F.col("text"))).withColumn("kind", line_kind(F.col("text")))
    prev = F.coalesce(F.lag("kind").over(w), F.lit("blank"))
    opens = (F.col("kind") == "field") | (F.col("kind").isin("metadata", "other") & prev.isin("blank", "heading"))
    d = d.withColumn("opens", opens).withColumns({
        "section_no": F.sum((F.col("kind") == "heading").cast("int")).over(w),
        "field_no": F.sum(F.col("opens").cast("int")).over(w),
        "section": F.coalesce(F.last(F.when(F.col("kind") == "heading", F.upper("text")), True).over(w), F.lit("GENERAL")),
    }).filter(F.col("kind").isin("field", "metadata", "other"))
    k = T.collapse_blanks(F.regexp_extract("text", KEY_VALUE_LINE, 1))
    v = T.collapse_blanks(F.regexp_extract("text", KEY_VALUE_LINE, 2))
    d = d.withColumns({"k": k, "v": v})
    open_only = lambda c: F.max(F.when(F.col("opens"), c))
    kv = F.col("k") != ""

    def last_meta(names: list[str], c: Column) -> Column:
        mine = ~F.col("opens") & (F.col("kind") == "metadata") & F.lower("k").isin(names)
        return F.max_by(F.when(mine, c), F.when(mine, F.col("line_no")))

    label0 = F.when(kv, F.col("k")).otherwise(F.col("text"))
    source = F.upper(F.substring_index(F.col("v"), ".", 1))
    own_source = F.when(F.lower("k").isin("source document", "document source"), source)
    own_static = F.when(kv & ~F.lower("k").isin("source document", "document source", "keywords"), F.col("v"))
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
        F.col("opens") | (F.col("kind") == "other"), F.struct("line_no", "text")))), lambda x: x["text"]), "\n")
    g = d.groupBy(key, "section_no", "section", "field_no").agg(
        F.coalesce(last_meta(METADATA_KEYS["label"], F.col("v")), open_only(label0)).alias("label"),
        F.coalesce(last_meta(METADATA_KEYS["field_code"], T.slug(F.col("v"))), open_only(T.slug(label0))).alias("field_code"),
        F.coalesce(last_meta(METADATA_KEYS["document_source"], source), open_only(own_source)).alias("document_source"),
        F.coalesce(last_meta(METADATA_KEYS["static_value"], F.col("v")), open_only(own_static)).alias("static_value"),
        raw.alias("raw_text"))
    return g.withColumns({
        "field_code": F.coalesce(F.nullif("field_code", F.lit("")), F.lit("field")),
        "field_type": field_type(F.col("label")),
    })


def flatten_spec(specs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaf fields of nested ``fields ARRAY<STRUCT<label, nested_fields ...>>``, depth first, as deep as the type goes.

    Returns the keys, ``depth`` (from 1), ``path`` (positions from the top) and ``label``. The leaves are gathered within the row, so the
    specs are read once at any depth. A spec without fields gives no row; an empty or null list of children makes a leaf.
    """
    def leaves(fields: Column, element: StructType, above: Column, depth: int) -> Column:
        def of(f: Column, i: Column) -> Column:
            path = F.concat(above, F.array(i))
            leaf = F.array(F.struct(F.lit(depth).alias("depth"), path.alias("path"), f["label"].alias("label")))
            if "nested_fields" not in element.names:
                return leaf
            below = f["nested_fields"]
            return F.when(F.coalesce(F.size(below), F.lit(0)) > 0, leaves(below, element["nested_fields"].dataType.elementType, path, depth + 1)).otherwise(leaf)

        return F.flatten(F.transform(fields, of))

    top = F.array().cast("array<int>")
    return specs.select(*keys, F.inline(leaves(F.col("fields"), specs.schema["fields"].dataType.elementType, top, 1)))


def required_fields(fields: DataFrame) -> DataFrame:
    return fields.filter("field_type = 'AUTO'").select("template_id", "field_name", "display_order").orderBy("template_id", "display_order")


def best_values(results: DataFrame, by: Sequence[str], doc_order: str = "doc_id") -> DataFrame:
    """Highest confidence non-empty value per key; the first document wins ties."""
    return results.filter(F.col("value") != "").groupBy(*by).agg(
        F.max(F.struct("confidence", (-F.col(doc_order)).alias("o"), "value")).alias("m")).select(
        *by, F.col("m.value").alias("value"), F.col("m.confidence").alias("confidence"), (-F.col("m.o")).alias(doc_order))


def map_template(fields: DataFrame, extracted: DataFrame, case: str = "case_id") -> DataFrame:
    """Template fields of a case with their extracted value: by canonical label, then by field code.

    ``fields`` is ``(case, field_name, field_code, canonical_name, field_type)``, ``extracted`` is
    ``(case, canonical_name, value, confidence 0..100)``. Rows with ``open`` go on to the candidate search.
    """
    ext = extracted.select(case, "canonical_name", "value", "confidence")
    by_label = ext.select(case, "canonical_name", F.struct("value", "confidence").alias("a"))
    by_code = ext.select(case, F.col("canonical_name").alias("field_code"), F.struct("value", "confidence").alias("b"))
    hit = F.coalesce("a", "b")
    auto = F.col("field_type") == "AUTO"
    conf = hit["confidence"] / 100.0
    found = auto & F.coalesce(hit["value"] != "", F.lit(False))
    return (
        fields.join(by_label, [case, "canonical_name"], "left").join(by_code, [case, "field_code"], "left")
        .select(
            case, "field_name", "field_code", "field_type",
            F.when(found, hit["value"]).otherwise(F.when(~auto, F.lit(""))).alias("extracted_value"),
            F.when(found, conf).alias("confidence"),
            (auto & (~found | (conf < REVIEW_BELOW))).alias("needs_review"),
            (auto & ~found).alias("open"))
    )


def map_saved(fields: DataFrame, saved: DataFrame) -> DataFrame:
    """Saved values by field code, else canonical label, else label."""
    s = saved.select("doc_id", F.col("name").alias("_n"), F.col("value").alias("_v"))
    out = fields
    for col in ("field_code", "canonical_name", "label"):
        out = out.join(s.withColumnsRenamed({"_n": col, "_v": f"_{col}"}), ["doc_id", col], "left")
    val = F.coalesce("_field_code", "_canonical_name", "_label")
    auto, section = F.col("field_type") == "AUTO", F.col("field_type") == "SECTION"
    return out.select(
        "doc_id", "label", "field_code", "field_type",
        F.when(section, "").otherwise(F.coalesce(val, F.lit(""))).alias("extracted_value"),
        F.when(auto, F.when(val.isNotNull(), 1.0).otherwise(0.0)).alias("confidence"),
        (auto & val.isNull()).alias("needs_review"))


def report_values(fields: DataFrame, values: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token values of a report: code, label, slug of the label, dynamic key, else the static value; explicit values last.

    ``fields`` is ``(key, ord, field_code, label, dynamic_value, static_value)``, ``values`` is ``(key, name, value)``.
    """
    of_slot = F.struct("ord", "field_code", "label", T.slug(T.collapse_blanks(F.col("label"))).alias("slug"), "dynamic_value", "static_value")
    of_value = F.struct("name", F.col("value").alias("v"))
    slots = fields.select(key, of_slot.alias("s"))
    given = values.filter(F.col("value") != "").select(key, of_value.alias("v"))
    # a report's fields and values meet in one grouping, so neither side is ever broadcast
    both = slots.unionByName(given, allowMissingColumns=True).groupBy(key).agg(F.collect_list("s").alias("ss"), F.collect_list("v").alias("vs"))
    of = lambda name: F.get(F.filter("vs", lambda x: x["name"] == name), F.lit(0))["v"]
    chosen = lambda s: F.coalesce(*[of(s[c]) for c in ("field_code", "label", "slug", "dynamic_value")], F.nullif(s["static_value"], F.lit("")))
    named = lambda s: T.let(chosen(s), lambda v: F.transform(F.array(s["field_code"], s["label"], s["slug"]), lambda n: F.struct(
        s["ord"].alias("ord"), n.alias("name"), v.alias("value"))))
    explicit = F.transform("vs", lambda x: F.struct(F.lit(1 << 30).alias("ord"), x["name"].alias("name"), x["v"].alias("value")))
    out = both.select(key, F.explode_outer(F.concat(F.flatten(F.transform("ss", named)), explicit)).alias("r")).select(key, "r.*")
    # explicit values of any name, fields' values of names that are not empty
    return out.filter(F.col("value").isNotNull() & ((F.col("name") != "") | (F.col("ord") == 1 << 30))).groupBy(key, "name").agg(F.max_by("value", "ord").alias("value"))


def render(text: Column, values: Column, spellings: Sequence[tuple[str, str]] = (("{{", "}}"),)) -> Column:
    """Replace tokens by their values, longest token first. ``values`` is ``ARRAY<STRUCT<name, value>>``."""
    longest = F.array_sort(values, lambda a, b: F.when(F.length(a["name"]) > F.length(b["name"]), -1)
                           .when(F.length(a["name"]) < F.length(b["name"]), 1).when(a["name"] < b["name"], -1)
                           .when(a["name"] > b["name"], 1).otherwise(0))

    def step(acc: Column, e: Column) -> Column:
        for left, right in spellings:
            acc = F.replace(acc, F.concat(F.lit(left), e["name"], F.lit(right)), F.coalesce(e["value"], F.lit("")))
        return acc

    return F.aggregate(longest, text, step)


ALL_SPELLINGS = (("{{", "}}"), ("{", "}"), ("[", "]"), ("<", ">"), ("", ""))


def unresolved_tokens(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"\{\{([a-zA-Z0-9_\s]+)\}\}"), F.lit(1))
    return docs.select(key, F.explode(found).alias("token")).select(key, T.strip(F.col("token")).alias("token")).distinct()


def structure_profile(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections, tables, rows and cells per document."""
    return docs.select(key, D.structure_counts(F.col("text")).alias("c")).select(key, "c.*").groupBy(key).agg(
        *[F.sum(c).alias(c) for c in ("sections", "tables", "rows", "cells")])


def structure_mismatch(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    cols = ["sections", "tables", "rows", "cells"]
    b = structure_profile(after, key).select(key, *[F.col(c).alias(f"{c}_after") for c in cols])
    j = structure_profile(before, key).join(b, key)
    changed = F.lit(False)
    for c in cols:
        changed = changed | (F.col(c) != F.col(f"{c}_after"))
    return j.filter(changed)


def known_tokens(fields: DataFrame, value_names: DataFrame) -> DataFrame:
    """Codes, labels, slugs and dynamic keys of the fields, and the value names, less the reserved header tokens."""
    own = fields.select(F.explode(F.array(
        "field_code", T.collapse_blanks(F.col("label")), T.slug(T.collapse_blanks(F.col("label"))), "dynamic_value")).alias("token"))
    return own.union(value_names.select("name")).filter(
        (F.col("token") != "") & ~F.col("token").isin(RESERVED_TOKENS)).distinct()


def refresh_fields(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The re-extracted templates replace their stored field lists; the others stay."""
    kept = stored.join(fresh.select("template_id").distinct(), "template_id", "left_anti")
    return kept.unionByName(fresh)


def slug_collisions(names: DataFrame) -> DataFrame:
    s = names.select("name", F.coalesce(F.nullif(T.slug(F.col("name")), F.lit("")), F.lit("field")).alias("slug"))
    return s.groupBy("slug").agg(F.count("*").alias("names"), F.min("name").alias("first_name")).filter("names > 1")
