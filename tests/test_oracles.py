"""A selection of registered queries against their DuckDB SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

DIR = "/root/testdata/sf0.001"
NAMES = ["b1_corpus_cleaning", "c1_sections", "c4_key_value_same_line", "c15_duplicate_merge", "d1_canonical_key", "e4_same_line_rule", "e13_free_text_candidates", "e16_rejected_candidates", "e18_best_candidates", "e21_requested_fields", "f9_field_validation",
         "g4_table_fields", "g9_template_mapping", "h1_field_metrics", "h6_accuracy", "j2_running_metrics"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
