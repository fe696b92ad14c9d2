"""Pieces of DuckDB SQL shared by the correctness checks (common table expressions over the given tables)."""

from __future__ import annotations

from ..functions import text as T
from ..sources import forms as Fm

BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in T.BLANKS)


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS_SQL})"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FACTS = f"""facts0 AS (
  SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, c_mktsegment, n_name, coalesce(items_qty, 0) AS qty,
         strftime(o_orderdate, '%d/%m/%Y') AS d_slash, strftime(o_orderdate, '%d-%m-%Y') AS d_dash
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS INT) AS items_qty FROM lineitem GROUP BY 1) i
    ON o_orderkey = l_orderkey),
facts AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in Fm.TRUTH.items())} FROM facts0)"""

FORMS = FACTS + f""",
forms AS (SELECT o_orderkey AS doc_id, o_custkey AS case_id, {Fm.FILE_NAME} AS file_name, {Fm.TEXT} AS text FROM facts)"""

CORPUS = FORMS + """,
docs AS (SELECT 'form' AS corpus, doc_id, text FROM forms UNION ALL SELECT 'prose', doc_id, text FROM documents)"""


def lines_of(source: str, keys: str = "corpus, doc_id", name: str = "lines") -> str:
    """Line table over ``source(keys, text)``."""
    return f"""{name}_a AS (
  SELECT {keys}, regexp_split_to_array(text, {lit(T.LINE_BREAK)}) AS a FROM {source} WHERE text <> ''),
{name}_b AS (SELECT {keys}, CASE WHEN a[len(a)] = '' THEN a[1:len(a)-1] ELSE a END AS a FROM {name}_a),
{name}_c AS (SELECT {keys}, unnest(a) AS raw, unnest(range(1, len(a) + 1)) AS line_no FROM {name}_b),
{name} AS MATERIALIZED (SELECT {keys}, CAST(line_no AS INT) AS line_no, {strip('raw')} AS text FROM {name}_c)"""


LINES = CORPUS + ",\n" + lines_of("docs")
FORM_LINES = FORMS + ",\n" + lines_of("forms", "doc_id", "flines")


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"
