"""Pages cut from a document's lines, their confidence, and report values in one grouping."""

from fieldloom.operators import layout as B
from fieldloom.operators import rules as E
from fieldloom.operators import templates as G
from fieldloom.plans import layout_queries
from fieldloom.sources import intake as I

DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_end_at_the_last_line_and_keep_blank_ones(spark):
    text = "a\n" + "\n" * 4 + "b  c\n|\n\n"
    docs = spark.createDataFrame([(1, text), (2, " \n\n"), (3, None), (4, "|")], "doc_id long, text string")
    rows = {(r.doc_id, r.page): [x.text for x in r.lines] for r in B.split_pages(docs, per_page=2, cells=True).collect()}
    assert rows == {(1, 1): ["a"], (1, 2): [], (1, 3): ["b", "c"]}
    plain = {(r.doc_id, r.page): [x.text for x in r.lines] for r in B.split_pages(docs, per_page=2).collect()}
    assert plain == {(1, 1): ["a"], (1, 2): [], (1, 3): ["b  c"], (1, 4): ["|"], (4, 1): ["|"]}


def test_mean_of_a_page_equals_that_of_its_lines(spark):
    docs = spark.createDataFrame([(1, "a\n\n\nb\nc"), (2, "x")], "doc_id long, text string")
    p = B.split_pages(docs, per_page=2)
    by_lines = {(r.doc_id, r.page): round(r.page_confidence, 9) for r in I.page_confidence(I.line_table(p), p, ["doc_id", "page"]).collect()}
    assert {(r.doc_id, r.page): round(r.page_confidence, 9) for r in I.page_means(p).collect()} == by_lines
    assert by_lines[(1, 2)] > 0


def test_recheck_and_page_confidence_make_the_pages_once(spark):
    for query in (layout_queries.b10, layout_queries.b6):
        assert plan_of(query(spark, DIR)).count("Relation [o_orderkey") == 1


def test_contains_rule_sends_labels_to_the_lines(spark):
    docs = spark.createDataFrame([(1, "The surVILLAGE: x"), (2, "no")], "doc_id long, text string")
    dim = E.field_labels(spark, ["village"], {"village": ["Village"]})
    rows = E.contains_rule(E.rule_lines(docs), E.open_requests(docs, ["village"]), dim)
    assert [(r.doc_id, r.value) for r in rows.collect()] == [(1, "x")]
    assert "gram" not in "".join(x for x in rows._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x)


def test_report_values_without_joins(spark):
    fields = spark.createDataFrame([(1, 0, "a_code", "A  b", None, "s"), (1, 1, "", "C", "dyn", ""), (2, 0, "z", "Z", None, None)],
                                   "doc_id long, ord int, field_code string, label string, dynamic_value string, static_value string")
    values = spark.createDataFrame([(1, "dyn", "D"), (1, "C", ""), (1, "a_b", "B"), (3, "only", "O")], "doc_id long, name string, value string")
    out = G.report_values(fields, values)
    assert {tuple(r) for r in out.collect()} == {(1, "a_code", "B"), (1, "A  b", "B"), (1, "a_b", "B"), (1, "C", "D"), (1, "c", "D"), (1, "dyn", "D"), (3, "only", "O")}
    assert "Join" not in plan_of(out)
