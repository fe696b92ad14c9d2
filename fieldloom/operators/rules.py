"""Rule cascade: requested field keys against the lines of a document, with a fixed confidence per rule.

Whole-word rules meet their labels by an equi-join on one word of the label. The later, costlier rules only see the
fields that the cheap ones left open (anti join). The winner per document and field is the smallest
(rule, line, label) triple, found by aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import similarity as Sim
from ..functions import text as T
from ..sources import dictionaries as Dic
from . import discovery as D
from . import label_search as L

# ---- fixed values -------------------------------------------------------------------------
CONFIDENCE = {"table": 0.99, "boundary": 0.98, "same_line": 0.97, "next_line": 0.95, "multiline": 0.94, "exact": 0.95,
              "fuzzy": 0.85, "regex": 0.80}
RULE_ORDER = ["table", "boundary", "same_line", "next_line", "multiline", "exact", "fuzzy", "regex"]
REDO_BELOW = 0.90
MULTILINE_FIELDS = ("postal_address_of_the_property owner_address purchaser_address property_description "
                    "brief_description_of_property remarks comments legal_opinion mortgage_details construction_specifications").split()
BOUNDARY_FIELDS = ("north_boundary south_boundary east_boundary west_boundary boundaries_north boundaries_south boundaries_east "
                   "boundaries_west").split()
NOISE_VALUES = ["gramkhantam", "abadi", "houseno", "door no", "plotno", "street / road", "locality name"]
GENERIC_STOPS = [
    "pvt ltd", "private limited", "m/s", "s/o", "w/o", "d/o", "h/o", "c/o", "company", "contractor", "signatory",
    "authorised signatory", "authorized signatory", "rep by its manager", "manager", "represented by", "relation", "witness",
    "wife of", "son of", "daughter of", "husband of", "care of", "late", "road", "street", "colony", "nagar", "town", "city",
    "mandal", "district", "state", "village",
]
FUZZY_SEPARATORS = [":", "=", " - ", " – ", " — "]
TABLE_ABOVE, FUZZY_ABOVE = 0.80, 0.75
FOLLOWING_LINES = 7
DATE_PATTERN = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
PIN_PATTERN = r"\d{6}"
SURVEY_PATTERN = r"\b[A-Za-z0-9/-]*\d+[A-Za-z0-9/-]*\b"
# field key part -> (pattern, words one of which the line must hold)
FIELD_PATTERNS = [
    ("inspection_date", DATE_PATTERN, []), ("valuation_date", DATE_PATTERN, []),
    ("postal_code", PIN_PATTERN, ["pin", "pincode", "postal", "zip", "code"]),
    ("pincode", PIN_PATTERN, ["pin", "pincode", "postal", "zip", "code"]),
    ("survey_number", SURVEY_PATTERN, ["survey", "sy", "s.no", "sno", "plot", "door"]),
    ("survey_no", SURVEY_PATTERN, ["survey", "sy", "s.no", "sno", "plot", "door"]),
    ("plot_no_survey_no", SURVEY_PATTERN, ["survey", "sy", "s.no", "sno", "plot", "door"]),
]
# -------------------------------------------------------------------------------------------

SEP_CLASS = r"[:\-–—=]"


def boundary_pattern(direction: str) -> str:
    return (rf"(?i)\b(?:bounded\s+on\s+(?:the\s+)?{direction}|{direction}\s+(?:boundary|side|direction)|"
            rf"(?<!\()(?<!\(\s){direction}(?!\))(?!\s*\)))\b\s*[:\-–—=]?\s*([^\n]+)")


def field_labels(spark: SparkSession, keys: Sequence[str], labels: dict[str, Sequence[str]] | None = None,
                 alias_path: str | None = None) -> DataFrame:
    """``(field_key, label, label_rank, anchor)``, longest label first: the caller's labels, the alias table (any size) at
    ``alias_path``, the built-in aliases, or the key's words where a key has none."""
    if labels is None and alias_path is not None:
        return _table_labels(spark, keys, alias_path)
    if labels is None:
        labels = {}
        first_dict: dict[str, int] = {}
        for d, key, _, alias, _ in sorted(Dic.builtin_alias_rows(), key=lambda r: (r[0], r[2], r[4])):
            if first_dict.setdefault(key, d) == d:
                labels.setdefault(key, []).append(alias)
    out = []
    for key in keys:
        ordered = sorted(labels.get(key) or [Dic.words_of(key)], key=len, reverse=True)
        out += [(key, a, i, L.anchor_word(a)) for i, a in enumerate(ordered)]
    return spark.createDataFrame(out, "field_key string, label string, label_rank int, anchor string")


def _table_labels(spark: SparkSession, keys: Sequence[str], path: str) -> DataFrame:
    """Labels from an alias table: the first dictionary that has a key gives all its labels; ranked within each key."""
    wanted = spark.createDataFrame([(k, Dic.words_of(k)) for k in keys], "field_key string, words string")
    rows = Dic.aliases(spark, path).join(F.broadcast(wanted.select("field_key")), "field_key")
    first = rows.groupBy("field_key").agg(F.min("dict_rank").alias("dict_rank"))
    own = rows.join(first, ["field_key", "dict_rank"]).select("field_key", F.col("alias").alias("label"), "key_rank", "alias_rank")
    bare = wanted.join(first, "field_key", "left_anti").select("field_key", F.col("words").alias("label"), F.lit(0).alias("key_rank"), F.lit(0).alias("alias_rank"))
    order = Window.partitionBy("field_key").orderBy(F.length("label").desc(), "key_rank", "alias_rank", "label")
    ranked = own.unionByName(bare).withColumn("label_rank", F.row_number().over(order) - 1)
    return L.label_dim_of(ranked.select("field_key", "label", "label_rank"))


def stop_labels(spark: SparkSession, aliases: Sequence[str] | None = None) -> DataFrame:
    """Labels that end a value: all aliases but the generic words."""
    names = aliases if aliases is not None else [a for _, _, _, a, _ in Dic.builtin_alias_rows()]
    kept = [a for a in dict.fromkeys(names) if a.lower().strip(" .:-–—=") not in GENERIC_STOPS]
    return L.label_dim(spark, kept).select(F.col("label").alias("stop"), "anchor")


def rule_lines(docs: DataFrame, key: str = "doc_id", following: int = FOLLOWING_LINES, holding: Sequence[str] | None = None) -> DataFrame:
    """Non-blank lines with their position and the lines that follow: ``i, line_no, text, ahead``.

    With ``following`` 0 there is no ``ahead``, and the position ``i``, which only orders lines, is their number. With
    ``holding`` only lines that hold one of these lower-cased words are made, so that the others are not copied with their followers.
    """
    if following == 0:
        return D.plain_lines(docs, [key]).select(key, F.col("line_no").alias("i"), "line_no", "text")

    def rows(ls: Column) -> Column:
        kept = F.filter(F.transform(ls, lambda x, n: F.struct((n + 1).alias("line_no"), x.alias("text"))), lambda r: r["text"] != "")
        made = lambda ks: lambda r, i: F.struct(
            i.alias("i"), r["line_no"].alias("line_no"), r["text"].alias("text"), F.slice(ks, i + 2, following).alias("ahead"))
        if holding is None:
            return T.let(kept, lambda ks: F.transform(ks, made(ks)))
        held = lambda r: T.let(F.lower(r["text"]), lambda low: T.contains_any(low, list(holding)))
        return T.let(kept, lambda ks: F.array_compact(F.transform(ks, lambda r, i: F.when(held(r), made(ks)(r, i)))))

    return (
        docs.select(key, F.explode_outer(T.let(T.stripped_lines(F.col("text")), rows)).alias("r"))
        .filter(F.col("r").isNotNull()).select(key, "r.*")
    )


def whole_label(label: Column) -> Column:
    return F.concat(F.lit(r"(?iU)(?<!\w)"), T.quote_regex(label), F.lit(r"(?!\w)"))


def label_hits(lines: DataFrame, dim: DataFrame) -> DataFrame:
    """Lines holding a label as whole words, with the text before and after it."""
    text, label = F.col("text"), F.col("label")
    part = lambda before, after: F.struct(before.alias("before"), T.strip(after).alias("after"))
    by_pattern = T.let(F.split(text, whole_label(label), 2), lambda x: F.when(F.size(x) > 1, part(F.get(x, F.lit(0)), F.get(x, F.lit(1)))))
    cut = T.let(L.whole_at(text, label, bare=True), lambda at: F.when(
        at > 0, part(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(label)))).when(at.isNull(), by_pattern))
    hits = L.only(L.anchor_join(lines, dim), "cut", cut, lambda x: x.isNotNull())
    return hits.withColumns({"before": F.col("cut.before"), "after": F.col("cut.after")}).drop("cut").withColumn(
        "rest", T.strip_separators(F.col("after")))


def _row(rule: str, value: Column, line_no: Column, label: Column, order: Column) -> list[Column]:
    return [F.lit(RULE_ORDER.index(rule)).alias("rule_rank"), F.col("i").alias("i"), order.cast("int").alias("k"),
            value.alias("value"), label.alias("matched_label"), line_no.cast("int").alias("source_line"),
            F.lit(rule).alias("match_type"), F.lit(CONFIDENCE[rule]).alias("confidence")]


def _in_parens(h: DataFrame) -> DataFrame:
    return h.filter(~F.rtrim("before").endswith("("))


def similar_labels(values: DataFrame, column: str, dim: DataFrame, above: float) -> DataFrame:
    """Distinct texts with the labels they resemble; texts and labels meet on the label lengths that can reach the ratio."""
    lab = dim.withColumn("label_len", F.length(Sim.sorted_tokens(F.col("label"))))
    v = values.select(column).distinct().withColumn("n", F.length(Sim.sorted_tokens(F.col(column)))).filter("n > 0")
    # 2 min / (m + n) > t  <=>  n t / (2 - t) < m < n (2 - t) / t
    low, high = F.floor(F.col("n") * (above / (2 - above))), F.ceil(F.col("n") * ((2 - above) / above))
    v = v.withColumn("label_len", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    pairs = v.join(F.broadcast(lab), "label_len").withColumn("ratio", Sim.token_sort_ratio(F.col("label"), F.col(column)))
    return pairs.filter(F.col("ratio") > above).select(column, "field_key", "label", "label_rank")


def table_rule(lines: DataFrame, dim: DataFrame, key: str = "doc_id") -> DataFrame:
    cells = F.filter(F.transform(F.split("text", r"\|", -1), T.strip), lambda c: c != "")
    rows = lines.filter(F.col("text").startswith("|") & F.col("text").endswith("|")).withColumn("cells", cells)
    rows = rows.filter(F.size("cells") >= 2).select(key, "i", "line_no", F.get("cells", F.lit(0)).alias("cell"), F.get("cells", F.lit(1)).alias("v"))
    same = dim.select(F.lower("label").alias("cell_key"), "field_key", "label", "label_rank")
    exact = rows.withColumn("cell_key", F.lower("cell")).join(F.broadcast(same), "cell_key").drop("cell_key")
    close = rows.join(similar_labels(rows.filter(F.length("cell") >= 3), "cell", dim, TABLE_ABOVE), "cell")
    return exact.unionByName(close).select(key, "field_key", *_row("table", F.col("v"), F.col("line_no"), F.col("label"), F.col("label_rank")))


def boundary_rule(lines: DataFrame, keys: Sequence[str], key: str = "doc_id") -> DataFrame | None:
    """The four compass fields."""
    wanted = [(k, d) for k in keys if k in BOUNDARY_FIELDS for d in ("north", "south", "east", "west") if d in k]
    if not wanted:
        return None
    found = F.array(*[F.struct(F.lit(k).alias("field_key"), F.lit(d.upper()).alias("label"), T.strip_separators(T.strip(
        F.regexp_extract("text", boundary_pattern(d), 1))).alias("v")) for k, d in wanted])
    rows = lines.filter(F.col("text").rlike("(?i)north|south|east|west")).select(key, "i", "line_no", F.explode(found).alias("h")).select(key, "i", "line_no", "h.*")
    return rows.filter(F.length("v") > 2).select(key, "field_key", *_row("boundary", F.col("v"), F.col("line_no"), F.col("label"), F.lit(0)))


def same_line_rule(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    short_ok = (F.length("label") > 1) | F.col("after").rlike("^" + SEP_CLASS)
    h = _in_parens(hits).filter(short_ok & (F.length("rest") > 1) & ~T.let(F.lower("rest"), lambda low: T.contains_any(low, NOISE_VALUES)))
    return h.select(key, "field_key", *_row("same_line", F.col("rest"), F.col("line_no"), F.col("label"), F.col("label_rank")))


def stops_in(texts: DataFrame, column: str, stops: DataFrame) -> DataFrame:
    """Distinct texts with the stop labels they carry (with a separator, or alone)."""
    t = texts.select(F.col(column).alias("text")).distinct()
    lab = T.quote_regex(F.col("stop"))
    with_sep = F.concat(F.lit(r"(?iU)(?<!\w)"), lab, F.lit(r"(?!\w)\s*" + SEP_CLASS))
    alone = F.concat(F.lit(r"(?iU)^[^\w]*"), lab, F.lit(r"[^\w]*$"))
    found = L.anchor_join(t, stops, label="stop").filter(F.regexp_like("text", with_sep) | F.regexp_like("text", alone))
    return found.groupBy(F.col("text").alias(column)).agg(F.collect_set("stop").alias("stops"))


def _own_labels(dim: DataFrame) -> DataFrame:
    return dim.groupBy("field_key").agg(F.collect_set("label").alias("own"))


def _foreign(stops: Column, own: Column) -> Column:
    return F.coalesce(F.size(F.array_except(stops, own)) > 0, F.lit(False))


def next_line_rule(hits: DataFrame, dim: DataFrame, stops: DataFrame, key: str = "doc_id") -> DataFrame:
    bare = ~F.col("rest").rlike("[a-zA-Z0-9]")
    short_ok = (F.length("label") > 1) | F.col("after").rlike("^" + SEP_CLASS) | ((F.col("before") == "") & F.col("after").rlike(f"^{SEP_CLASS}?$"))
    h = _in_parens(hits).filter(bare & short_ok & (F.size("ahead") > 0)).withColumns({
        "next_text": F.get("ahead", F.lit(0))["text"], "next_no": F.get("ahead", F.lit(0))["line_no"]})
    h = h.join(stops_in(h, "next_text", stops), "next_text", "left").join(F.broadcast(_own_labels(dim)), "field_key")
    return h.filter(~_foreign(F.col("stops"), F.col("own"))).select(
        key, "field_key", *_row("next_line", F.col("next_text"), F.col("next_no"), F.col("label"), F.col("label_rank")))


def multiline_rule(hits: DataFrame, dim: DataFrame, stops: DataFrame, key: str = "doc_id") -> DataFrame:
    """Up to seven lines until one carries the label of another field."""
    h = hits.filter(F.col("field_key").isin(MULTILINE_FIELDS))
    inline = F.col("rest").rlike("[a-zA-Z0-9]") | (F.size("ahead") == 0)
    own_line = F.array(F.struct("line_no", "text"))
    h = h.withColumn("block", F.slice(F.when(inline, F.concat(own_line, "ahead")).otherwise(F.col("ahead")), 1, FOLLOWING_LINES))
    parts = h.select(key, "field_key", "i", "line_no", "label", "label_rank", F.posexplode("block").alias("p", "b")).withColumn("part", F.col("b.text"))
    parts = parts.join(stops_in(parts, "part", stops), "part", "left").join(F.broadcast(_own_labels(dim)), "field_key")
    stop_at = F.min(F.when((F.col("p") > 0) & _foreign(F.col("stops"), F.col("own")), F.col("p")))
    g = parts.groupBy(key, "field_key", "i", "line_no", "label", "label_rank").agg(
        stop_at.alias("stop_at"), F.array_sort(F.collect_list(F.struct("p", "part"))).alias("ps"))
    kept = F.when(F.col("stop_at").isNull(), F.col("ps")).otherwise(F.slice("ps", 1, F.col("stop_at")))
    value = F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["part"]), ", "), r"\s+", " ")
    return g.select(key, "field_key", *_row("multiline", value, F.col("line_no"), F.col("label"), F.col("label_rank")))


def contains_rule(lines: DataFrame, open_fields: DataFrame, dim: DataFrame, key: str = "doc_id") -> DataFrame:
    """The label anywhere in the line, for the fields still open.

    Lines and labels meet on the label's first three letters, which the line must hold; the whole label is checked then.
    """
    d = dim.filter(F.length("label") >= 3).select("field_key", "label", "label_rank", F.substring(F.lower("label"), 1, 3).alias("gram"))
    grams = T.let(F.lower("text"), lambda low: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substr(low, i, F.lit(3)))))
    starts = lines.filter(F.length("text") >= 3).select(key, "i", "line_no", "text", F.explode_outer(grams).alias("gram"))
    # labels go to the lines, as in the other rules: only lines that hold a label are exchanged, never their letters
    h = starts.join(F.broadcast(d), "gram").filter(F.lower("text").contains(F.lower("label"))).join(open_fields, [key, "field_key"], "left_semi")
    at = F.call_function("locate", F.lower("label"), F.lower("text"))
    rest = T.strip_separators(T.strip(F.substr("text", at + F.length("label"))))
    return h.withColumn("rest", rest).filter("rest <> ''").select(
        key, "field_key", *_row("exact", F.col("rest"), F.col("line_no"), F.col("label"), F.col("label_rank")))


def fuzzy_rule(lines: DataFrame, open_fields: DataFrame, dim: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left part of a separator, or the whole line, resembles a label; the value is the right part, or the next line."""
    t = F.col("text")
    halves = F.array_compact(F.array(*[
        F.when(t.contains(s), F.struct(F.lit(n).alias("sep"), F.split(t, _plain(s), 2)[0].alias("left"), F.split(t, _plain(s), 2)[1].alias("right")))
        for n, s in enumerate(FUZZY_SEPARATORS)]))
    whole = F.struct(F.lit(9).alias("sep"), t.alias("left"), F.get("ahead", F.lit(0))["text"].alias("right"))
    # lines of documents with an open field only
    wanted = lines.join(open_fields.select(key).distinct(), key, "left_semi")
    rows = wanted.select(key, "i", "line_no", F.explode(T.let(halves, lambda hs: F.when(F.size(hs) > 0, hs).otherwise(F.array(whole)))).alias("h"))
    rows = rows.select(key, "i", "line_no", "h.*").withColumn("v", T.strip_separators(T.strip(F.col("right"))))
    rows = rows.filter((F.length(T.strip(F.col("left"))) >= 4) & (F.col("v") != ""))
    near = similar_labels(rows, "left", dim.filter(F.length("label") >= 4), FUZZY_ABOVE)
    return rows.join(near, "left").join(open_fields, [key, "field_key"]).select(
        key, "field_key", *_row("fuzzy", F.col("v"), F.col("line_no"), F.col("label"), F.col("sep") * 1000 + F.col("label_rank")))


def _plain(s: str) -> str:
    return "".join("\\" + c if c in "-=" else c for c in s)


def pattern_rule(lines: DataFrame, open_fields: DataFrame, keys: Sequence[str], key: str = "doc_id") -> DataFrame | None:
    """Date, pin and survey patterns by field key; a village line gives its text up to the word."""
    t, found = F.col("text"), []
    for k in keys:
        hit = next(((p, w) for part, p, w in FIELD_PATTERNS if part in k), None)
        if hit:
            ok = T.contains_any(F.lower(t), hit[1]) if hit[1] else F.lit(True)
            found.append(F.struct(F.lit(k).alias("field_key"), F.lit(k).alias("label"), F.when(ok, F.regexp_extract(t, hit[0], 0)).alias("v")))
        elif "village" in k:
            found.append(F.struct(F.lit(k).alias("field_key"), F.lit("VILLAGE").alias("label"), T.strip(F.regexp_extract(t, r"(?i).*\bVILLAGE\b", 0)).alias("v")))
    if not found:
        return None
    wanted = lines.join(open_fields.select(key).distinct(), key, "left_semi")
    rows = wanted.select(key, "i", "line_no", F.explode(F.array(*found)).alias("h")).select(key, "i", "line_no", "h.*").filter("v <> ''")
    return rows.join(open_fields, [key, "field_key"]).select(
        key, "field_key", *_row("regex", F.col("v"), F.col("line_no"), F.col("label"), F.lit(0)))


def first_match(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """The winner per document and field: smallest rule, line, label."""
    rest = ["value", "matched_label", "source_line", "match_type", "confidence"]
    return rows.groupBy(key, "field_key").agg(F.min_by(F.struct(*rest), F.struct("rule_rank", "i", "k")).alias("m")).select(
        key, "field_key", F.btrim(T.strip(F.col("m.value")), F.lit("| ")).alias("value"), *[F.col(f"m.{c}").alias(c) for c in rest[1:]])


def open_requests(docs: DataFrame, keys: Sequence[str], stored: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Requested (document, field) pairs whose stored confidence is below the redo limit."""
    req = docs.select(key, F.explode(F.array(*[F.lit(k) for k in keys])).alias("field_key"))
    if stored is None:
        return req
    sure = stored.filter(F.coalesce("confidence", F.lit(0.0)) >= REDO_BELOW).select(key, "field_key")
    return req.join(sure, [key, "field_key"], "left_anti")


def cascade(docs: DataFrame, keys: Sequence[str], labels: dict[str, Sequence[str]] | None = None,
            stored: DataFrame | None = None, stops: Sequence[str] | None = None, key: str = "doc_id", alias_path: str | None = None) -> DataFrame:
    """All rules in order; the first hit per document and field wins."""
    spark = docs.sparkSession
    dim, stop = field_labels(spark, keys, labels, alias_path), stop_labels(spark, stops)
    wanted = open_requests(docs, keys, stored, key)
    if stored is not None:  # documents without an open field are not read further
        docs = docs.join(wanted.select(key).distinct(), key, "left_semi")
    # every rule reads the lines, and three of them the label hits
    lines = rule_lines(docs, key).persist()
    hits = label_hits(lines, dim).persist()
    cheap = [table_rule(lines, dim, key), boundary_rule(lines, keys, key), same_line_rule(hits, key),
             next_line_rule(hits, dim, stop, key), multiline_rule(hits, dim, stop, key)]
    found = None
    for r in cheap:
        if r is not None:
            found = r if found is None else found.unionByName(r)
    done = first_match(found.join(wanted, [key, "field_key"], "left_semi"), key)
    left = wanted.join(done.select(key, "field_key"), [key, "field_key"], "left_anti")
    late = contains_rule(lines, left, dim, key).unionByName(fuzzy_rule(lines, left, dim, key))
    by_pattern = pattern_rule(lines, left, keys, key)
    if by_pattern is not None:
        late = late.unionByName(by_pattern)
    return done.unionByName(first_match(late, key))
