"""Registered queries of the intake, text and discovery operators, each with its DuckDB check."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import discovery as D
from ..sources import forms as Fm
from . import sqlkit as S
from .queries_base import collector

QUERIES, ORACLES, query = collector()

# ---- the independent SQL formulation of lines, sections, tables and candidates --------------
HEADING = """(text <> '' AND (starts_with(text, '#') OR (upper(text) = text AND lower(text) <> text AND length(text) BETWEEN 4 AND 60)
  OR (ends_with(text, ':') AND length(text) < 40 AND (contains(lower(text), 'details') OR contains(lower(text), 'schedule')
      OR contains(lower(text), 'information')))))"""
W = "OVER (PARTITION BY corpus, doc_id ORDER BY line_no)"
SECTION_LINES = S.LINES + f""",
hd AS (SELECT *, {HEADING} AS h, lead(text) {W} AS next_text FROM lines),
sl AS (SELECT *, CAST(sum(CAST(h AS INT)) {W} AS INT) AS section_no FROM hd),
bounds AS (SELECT corpus, doc_id, section_no, min(line_no) AS a, max(line_no) AS b, min_by(text, line_no) AS first_text
           FROM sl GROUP BY 1, 2, 3),
secs AS (
  SELECT corpus, doc_id, section_no, {S.strip("rtrim(ltrim(first_text, '# '), ':')")} AS heading, a AS start_line, b AS end_line
  FROM bounds WHERE section_no > 0
  UNION ALL
  SELECT d.corpus, d.doc_id, 0, 'Document Start', 1, coalesce(b, 0) FROM docs d
  LEFT JOIN (SELECT * FROM bounds WHERE section_no = 0) x ON d.corpus = x.corpus AND d.doc_id = x.doc_id),
tl AS (SELECT sl.corpus, sl.doc_id, sl.section_no, heading, start_line, line_no, text, next_text,
         CAST(row_number() OVER (PARTITION BY sl.corpus, sl.doc_id, sl.section_no ORDER BY line_no) - 1 AS INT) AS nth
       FROM sl JOIN secs ON sl.corpus = secs.corpus AND sl.doc_id = secs.doc_id AND sl.section_no = secs.section_no
       WHERE text <> '')"""

KV = S.lit(D.KEY_VALUE)
TV = S.lit(D.TITLE_VALUE)
SEP_LEAD = S.lit(f"^[{T.SEPARATORS}{T.BLANK_SET}]+")

TABLE_ROWS = S.LINES + f""",
tr AS (SELECT *, (contains(text, '|') OR contains(text, '  ')) AS is_row FROM lines),
ti AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) {W} AS island FROM tr),
tp AS (SELECT corpus, doc_id, line_no, island, list_filter(list_transform(
         CASE WHEN contains(text, '|') THEN string_split(text, '|') ELSE regexp_split_to_array(text, {S.lit(T.BLANK + '{2,}')}) END,
         lambda p: {S.strip('p')}), lambda p: p <> '') AS parts FROM ti WHERE is_row),
tk AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY corpus, doc_id ORDER BY island) - 1 AS INT) AS table_no,
         row_number() OVER (PARTITION BY corpus, doc_id, island ORDER BY line_no) AS row_no,
         first(parts) OVER (PARTITION BY corpus, doc_id, island ORDER BY line_no) AS headers
       FROM tp WHERE len(list_filter(parts, lambda p: NOT regexp_full_match(p, '[:\\-]+'))) > 0)"""


def cand(label, value, line, conf, strategy, rank, k1="0", k2="0", k3="0", k4="0"):
    return (f"corpus, doc_id, {label} AS label, {value} AS value, CAST({line} AS INT) AS source_line, "
            f"CAST({conf} AS DOUBLE) AS ocr_confidence, '{strategy}' AS strategy, {rank} AS k0, {k1} AS k1, {k2} AS k2, "
            f"{k3} AS k3, {k4} AS k4")


kv_same = f"""SELECT * FROM (SELECT {cand(S.strip(f"regexp_extract(text, {KV}, 1)"),
    S.strip(f"regexp_replace({S.strip(f'regexp_extract(text, {KV}, 2)')}, {SEP_LEAD}, '')"), 'line_no', 0.95, 'key_value', 1, 'line_no')}
  FROM tl WHERE regexp_matches(text, {KV})) WHERE length(label) >= 2 AND length(value) >= 2 AND NOT ends_with(lower(label), 'and between')"""
kv_next = f"""SELECT {cand("rtrim(text, ':')", 'next_text', 'line_no', 0.90, 'key_value', 1, 'line_no', '1')} FROM tl
  WHERE length(text) BETWEEN 2 AND 39 AND regexp_matches(text, '\\p{{L}}') AND NOT regexp_matches(text, {KV})
  AND length(next_text) BETWEEN 2 AND 249 AND NOT ends_with(next_text, ':') AND NOT regexp_matches(next_text, {KV})"""
tab_col = f"""SELECT {cand('label', 'value', 'line_no', 0.90, 'table', 2, 'table_no', '0', 'line_no', 'c')} FROM (
  SELECT corpus, doc_id, table_no, line_no, c - 1 AS c, headers[c] AS label, parts[c] AS value FROM (
    SELECT *, unnest(range(1, least(len(parts), len(headers)) + 1)) AS c FROM tk WHERE row_no > 1))
  WHERE length(label) >= 2 AND length(value) >= 2"""
tab_adj = f"""SELECT {cand('label', 'value', 'line_no', 0.88, 'table', 2, 'table_no', '1', 'line_no', 'c')} FROM (
  SELECT corpus, doc_id, table_no, line_no, c - 1 AS c, parts[c] AS label, parts[c + 1] AS value FROM (
    SELECT *, unnest(range(1, len(parts))) AS c FROM tk))
  WHERE length(label) BETWEEN 2 AND 59 AND length(value) >= 2 AND NOT ends_with(value, ':')"""
sect = f"""SELECT {cand('heading', 'text', 'start_line + nth', 0.80, 'section', 3, 'section_no', 'nth')} FROM tl
  WHERE heading <> '' AND heading <> 'Document Start' AND text <> heading AND length(text) BETWEEN 2 AND 149"""
near_h = f"""SELECT * FROM (SELECT {cand(S.strip(f"regexp_extract(text, {TV}, 1)"), S.strip(f"regexp_extract(text, {TV}, 2)"),
    'line_no', 0.85, 'nearby_label', 4, 'line_no')} FROM tl WHERE regexp_matches(text, {TV}))
  WHERE length(label) >= 2 AND length(value) >= 2"""
near_v = f"""SELECT {cand('text', 'next_text', 'line_no', 0.80, 'nearby_label', 4, 'line_no', '1')} FROM tl
  WHERE length(text) BETWEEN 2 AND 29 AND regexp_full_match(text, '\\p{{Lu}}[\\p{{L}} ]*') AND length(next_text) BETWEEN 2 AND 149"""
REL = S.lit(r"(?i)\b(" + D.RELATIONS + r")\b")
# the phrases are found one at a time, each search starting after the last hit
REL_STEPS = f"""rel_base AS (SELECT corpus, doc_id, line_no, text FROM tl WHERE length(text) > 40 AND regexp_matches(text, {REL})),
rel_hits AS (SELECT corpus, doc_id, line_no, text, regexp_extract_all(text, {REL}) AS ps, regexp_split_to_array(text, {REL}) AS ss FROM rel_base),
rel_rows AS (SELECT corpus, doc_id, line_no, i - 1 AS n, trim(ps[i]) AS phrase,
    {S.strip("list_reduce(list_transform(range(1, i + 1), lambda j: ss[j] || CASE WHEN j < i THEN ps[j] ELSE '' END), lambda x, y: x || y)")} AS lft,
    {S.strip("list_reduce(list_transform(range(i + 1, len(ss) + 1), lambda j: ss[j] || CASE WHEN j < len(ss) THEN ps[j] ELSE '' END), lambda x, y: x || y)")} AS rgt
  FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM rel_hits)),
rel_lab AS (SELECT corpus, doc_id, line_no, n, phrase, rgt,
    trim(array_to_string(list_slice(w, greatest(len(w) - 2, 1), len(w)), ' '), '.,;: ') AS tail
  FROM (SELECT *, regexp_split_to_array(lft, {S.lit(T.BLANK + '+')}) AS w FROM rel_rows)),
rel_out AS (SELECT corpus, doc_id, line_no, n,
    regexp_replace(CASE WHEN tail <> '' THEN tail || ' ' || phrase ELSE phrase END, '(?i)^(the|a|an)\\s+', '') AS label,
    trim(regexp_split_to_array(rgt, '[,;:|]')[1], '.,;: ') AS value FROM rel_lab)"""
rel = f"""SELECT {cand('label', 'value', 'line_no', 0.75, 'paragraph', 5, 'line_no', 'n')} FROM rel_out
  WHERE length(label) BETWEEN 2 AND 39 AND length(value) BETWEEN 2 AND 149"""

OUT = "corpus, doc_id, label, value, source_line, ocr_confidence"
ALL_CTES = (SECTION_LINES + TABLE_ROWS[len(S.LINES):] + ",\n" + REL_STEPS + f""",
kv_same AS ({kv_same}), kv_next AS ({kv_next}), tab_col AS ({tab_col}), tab_adj AS ({tab_adj}), sect AS ({sect}),
near_h AS ({near_h}), near_v AS ({near_v}), rel AS ({rel}),
found AS (SELECT * FROM kv_same UNION ALL SELECT * FROM kv_next UNION ALL SELECT * FROM tab_col UNION ALL SELECT * FROM tab_adj
  UNION ALL SELECT * FROM sect UNION ALL SELECT * FROM near_h UNION ALL SELECT * FROM near_v UNION ALL SELECT * FROM rel)""")

_punct = "regexp_full_match({x}, '[.,:;!?\\-_–—=+|/\\\\()\\[\\]{{}}#*`~ ''\"]*')"
_rep = ("len(list_filter(range(1, length({x}) - 3), lambda i: substr({x}, i, 5) = repeat(substr({x}, i, 1), 5))) > 0")
_stop = "(" + ", ".join(S.lit(w) for w in D.STOPWORDS) + ")"


def sql_reason(label="label", value="value"):
    lab, val = "lab", "val"
    return f"""CASE WHEN lab = '' OR val = '' OR lab IS NULL OR val IS NULL THEN 'empty'
  WHEN {_punct.format(x=lab)} OR {_punct.format(x=val)} THEN 'punctuation'
  WHEN length(lab) < 2 AND NOT regexp_matches(lab, '[\\p{{L}}\\p{{N}}]') THEN 'short_label'
  WHEN length(val) = 1 AND NOT regexp_matches(val, '\\p{{Nd}}') THEN 'short_value'
  WHEN length(val) > 400 THEN 'long_value'
  WHEN lower(lab) IN {_stop} OR lower(val) IN {_stop} THEN 'stopword'
  WHEN NOT regexp_matches(lab, '[\\p{{L}}\\p{{N}}]') OR NOT regexp_matches(val, '[\\p{{L}}\\p{{N}}]') THEN 'no_word'
  WHEN {_rep.format(x=val)} OR {_rep.format(x=lab)} THEN 'repeated'
  WHEN starts_with(val, ',') OR starts_with(val, '(including') OR starts_with(val, '(includes')
    OR ends_with(lower(val), 'between:-') OR ends_with(lower(val), 'at the time of registration.') THEN 'fragment' END"""


GATED = ALL_CTES + f""",
stripped AS (SELECT *, {S.strip('label')} AS lab, {S.strip('value')} AS val FROM found),
judged AS (SELECT *, {sql_reason()} AS reason FROM stripped),
good AS (SELECT * FROM judged WHERE reason IS NULL),
ranked AS (SELECT *, lower(lab) AS label_key, lower(val) AS value_key, row_number() OVER (
    PARTITION BY corpus, doc_id, lower(lab), lower(val) ORDER BY ocr_confidence DESC, k0, k1, k2, k3, k4) AS rn FROM good),
names AS (SELECT corpus, doc_id, label_key, value_key, array_to_string(list_sort(list_distinct(list(strategy))), ', ') AS strategies
  FROM ranked GROUP BY ALL),
merged AS (SELECT r.corpus, r.doc_id, r.label_key, r.value_key, label, value, source_line, ocr_confidence, strategies
  FROM ranked r JOIN names n ON r.corpus = n.corpus AND r.doc_id = n.doc_id AND r.label_key = n.label_key AND r.value_key = n.value_key
  WHERE rn = 1)"""


def _lines(spark, d):
    return D.section_lines(Fm.corpus(spark, d))


def _plain(spark, d):
    return D.plain_lines(Fm.corpus(spark, d))


def _pairs(spark, d):
    return D.plain_lines(Fm.corpus(spark, d), following=True)


def _tables(spark, d):
    return D.tables(Fm.corpus(spark, d))


@query("b2_line_explode", S.with_(S.LINES, "SELECT corpus, doc_id, line_no, text FROM lines"))
def b2(spark, d):
    return D.line_rows(Fm.corpus(spark, d))


@query("c1_sections", S.with_(SECTION_LINES, "SELECT corpus, doc_id, section_no, heading, start_line, end_line FROM secs"))
def c1(spark, d):
    return D.sections(Fm.corpus(spark, d)).select("corpus", "doc_id", "section_no", "heading", "start_line", "end_line")


@query("c2_section_of_line", S.with_(SECTION_LINES, "SELECT corpus, doc_id, line_no, section_no, heading FROM tl"))
def c2(spark, d):
    return _lines(spark, d).select("corpus", "doc_id", "line_no", "section_no", "heading")


@query("c3_context_window", S.with_(S.LINES, f"""SELECT corpus, doc_id, line_no, array_to_string(list(text) OVER (
  PARTITION BY corpus, doc_id ORDER BY line_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), chr(10)) AS context_window FROM lines"""))
def c3(spark, d):
    return D.context_windows(Fm.corpus(spark, d))


def _strategy(name, cte, fn, source):
    sql = S.with_(ALL_CTES, f"SELECT {OUT} FROM {cte}")

    def run(spark, d, fn=fn, source=source):
        return D.apply_strategies(source(spark, d), [fn]).select(
            "corpus", "doc_id", "label", "value", "source_line", "ocr_confidence")

    QUERIES[name] = run
    ORACLES[name] = sql


_strategy("c4_key_value_same_line", "kv_same", D.key_value_same_line, _plain)
_strategy("c5_key_value_next_line", "kv_next", D.key_value_next_line, _pairs)


@query("c6_tables", S.with_(TABLE_ROWS, "SELECT corpus, doc_id, table_no, line_no, array_to_string(parts, ' / ') AS parts FROM tk"))
def c6(spark, d):
    return _tables(spark, d).select("corpus", "doc_id", "table_no", F.explode("rows").alias("r")).select(
        "corpus", "doc_id", "table_no", F.col("r.line_no").alias("line_no"), F.array_join("r.parts", " / ").alias("parts"))


_strategy("c7_table_by_column", "tab_col", D.table_by_column, _tables)
_strategy("c8_table_adjacent", "tab_adj", D.table_adjacent, _tables)
_strategy("c9_section_candidates", "sect", D.section_candidates, _lines)
_strategy("c10_nearby_horizontal", "near_h", D.nearby_horizontal, _plain)
_strategy("c11_nearby_vertical", "near_v", D.nearby_vertical, _pairs)
_strategy("c12_relational_phrases", "rel", D.relational, _plain)


@query("c13_strategy_union", S.with_(ALL_CTES, "SELECT corpus, strategy, count(*) AS n, count(DISTINCT doc_id) AS docs FROM found GROUP BY 1, 2"))
def c13(spark, d):
    return D.discover(Fm.corpus(spark, d)).groupBy("corpus", "strategy").agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("c14_quality_gate", S.with_(GATED, f"SELECT corpus, doc_id, label, value, source_line, coalesce(reason, 'kept') AS reason FROM judged"))
def c14(spark, d):
    return D.discover(Fm.corpus(spark, d)).select(
        "corpus", "doc_id", "label", "value", "source_line",
        F.coalesce(D.reject_reason(F.col("label"), F.col("value")), F.lit("kept")).alias("reason"))


@query("c15_duplicate_merge", S.with_(GATED, f"SELECT {OUT}, strategies AS strategy FROM merged"))
def c15(spark, d):
    return D.candidates(Fm.corpus(spark, d)).select(
        "corpus", "doc_id", "label", "value", "source_line", "ocr_confidence", "strategy")


@query("candidates_by_strategy", S.with_(GATED, """SELECT corpus, strategies AS strategy, count(*) AS candidates,
  count(DISTINCT doc_id) AS docs, round(avg(ocr_confidence), 6) AS mean_confidence FROM merged GROUP BY 1, 2"""))
def flagship(spark, d):
    return D.candidates(Fm.corpus(spark, d)).groupBy("corpus", "strategy").agg(
        F.count("*").alias("candidates"), F.countDistinct("doc_id").alias("docs"),
        F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"))
