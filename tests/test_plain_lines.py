"""Lines without sections or followers against the paths that have them."""

from pyspark.sql import functions as F

from fieldloom.operators import discovery as D
from fieldloom.operators import label_search as L
from fieldloom.operators import rules as E
from fieldloom.operators import templates as G

TEXTS = ["Owner Name: A\n\nPROPERTY DETAILS\n  Plot : 7 \r\n| a | b |\n| --- | --- |\n| 1 | 2 |\nDistrict\nMedak\n", "x y: z\n", "\n\n", "", None, "one  two  three"]


def test_plain_lines_agree_with_the_lines_of_sections(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    rows = lambda df, *cols: sorted(map(tuple, df.select("doc_id", *cols).collect()), key=str)
    own = D.section_lines(docs, ["doc_id"])
    assert rows(D.plain_lines(docs, ["doc_id"], following=True), "line_no", "text", "next_text") == rows(own, "line_no", "text", "next_text")
    assert rows(E.rule_lines(docs, following=0), "line_no", "text") == rows(E.rule_lines(docs), "line_no", "text")
    assert rows(L.with_following(docs, ahead=0), "line_no", "text") == rows(L.with_following(docs), "line_no", "text")
    assert "ahead" not in E.rule_lines(docs, following=0).columns and "following" not in L.with_following(docs, ahead=0).columns
    kv = D.apply_strategies(own, [D.key_value_same_line], ["doc_id"])
    assert rows(D.key_values(docs, ["doc_id"]), "label", "value", "source_line") == rows(kv, "label", "value", "source_line")


def test_structure_is_counted_within_the_row(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = G.structure_profile(docs)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    sec = {r.doc_id: r.n for r in D.sections(docs, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    tabs = {}
    for r in D.tables(docs, ["doc_id"]).collect():
        t = tabs.setdefault(r.doc_id, [0, 0, 0])
        t[:] = t[0] + 1, t[1] + len(r.rows), t[2] + sum(len(x.parts) for x in r.rows)
    assert {r.doc_id: (r.sections, r.tables, r.rows, r.cells) for r in got.collect()} == {i: (sec[i], *tabs.get(i, [0, 0, 0])) for i in sec}
