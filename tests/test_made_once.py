"""Values that must be made once: plans do not repeat them, and the results are those of the plain definitions."""

import random
import re
import time

from pyspark.sql import functions as F

from fieldloom.operators import derive as V
from fieldloom.operators import discovery as D
from fieldloom.operators import lookup as K
from fieldloom.operators import numbers as N
from fieldloom.operators import rules as E
from fieldloom.operators import scored as C
from fieldloom.operators import templates as G
from fieldloom.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_party_block_is_made_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 20)
    p = plan(registry.queries()["f4_party_block"](spark, SF))
    # each of the four patterns once (before: more than 400 pattern functions, once for each use of the block)
    assert p.count("(?i)Name\\s+of\\s+the\\s+purchaser") == 1 and len(re.findall(r"regexp_|RLIKE|split\(", p)) < 120
    texts = ["PURCHASER: Ravi Kumar, 9876543210", "Second  Party: X", "Second Party : Ravi Teja\nValuation", "no one", "", None, "Vendee - Anil Rao, Main road\nnear lake"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.b and tuple(r.b) for r in df.select(V.split_party(V.party_block(F.col("t"))).alias("b")).collect()]
    assert got == [("Ravi Kumar", None, "9876543210"), None, ("Ravi Teja", None, None), None, None, None, ("Anil Rao", "Main road near lake", None)]


def test_recognised_lines_are_made_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 1 << 20)
    # the form's text stands in the plan once for each of the two shapes, no filter on the lines makes it again
    assert plan(registry.queries()["b11_recogniser_shapes"](spark, SF)).count("This paper is dated") == 2


def test_free_text_is_searched_once_for_all_rules_of_a_pattern(spark):
    area = plan(registry.queries()["e13_free_text_candidates"](spark, SF)).count("square\\s*feet")
    assert area == 4  # found once, cut once, and a value for each of two fields
    docs = spark.createDataFrame([(1, "x\nA 10 sft, a\nB 20 sq.\nft, b\nend"), (2, None), (3, ""), (4, "Net Plot Area is 1/A\nof 3/C, 4/D\nNet Plot Area: 5/E")], "doc_id int, text string")
    got = sorted(tuple(r) for r in C.free_text_candidates(docs, ["land_area", "built_up_area", "survey_number"]).select("doc_id", "field_key", "k", "source", "value", "line").collect())
    area = [(0, "10 sft", "A 10 sft, a"), (1, "20 sq.\nft", "B 20 sq.")]
    want = [(1, f, k, "standalone_area_regex", v, line) for f in ("built_up_area", "land_area") for k, v, line in area]
    want += [(4, "survey_number", 0, "net_plot_regex", "1/A", "Net Plot Area is 1/A")]
    want += [(4, "survey_number", k, "standalone_survey_regex", v, line) for k, v, line in (
        (0, "1/A", "Net Plot Area is 1/A"), (1, "3/C, 4/D", "of 3/C, 4/D"), (2, "5/E", "Net Plot Area: 5/E"))]
    assert got == sorted(want)


def test_permit_number_in_one_long_word(spark):
    # a start at each character of a word took time with the square of its length
    df = spark.createDataFrame([("A1" * 100_000 + " of PERMIT No. 7/C2/TP3",), ("z 12/AB34 PERMIT",), ("A1PERMIT9/TP File No. X",)], "t string")
    start = time.time()
    assert [r.p for r in df.select(N.permit_number(F.col("t")).alias("p")).collect()] == ["7/C2/TP3", "12/AB34", "A1PERMIT9/TP"]
    assert time.time() - start < 60


def test_template_fields_within_the_row_are_those_of_the_lines(spark):
    p = plan(registry.queries()["g5_template_lines"](spark, SF))
    assert "Window" not in p and p.count("Aggregate") == 1  # the order's items
    pick = random.Random(4)
    parts = ["", "HEAD ONE", "TWO", "Name: x", "Owner = y  z", "Label: Full name", "code: A b", "Source: deed.p1", "static: 5", "keywords: a", "some words", "Ends:", ": odd", "Source Document: q.r"]
    rows = [(i, "\n".join(pick.choice(parts) for _ in range(pick.randint(0, 14)))) for i in range(400)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    want = G.parse_spec_lines(D.line_rows(docs, ["doc_id"]))
    of = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert of(G.parse_specs(docs)) == of(want) and want.count() > 500


def test_labelled_lookup_makes_only_lines_with_an_anchor_word(spark):
    docs = spark.createDataFrame([(1, "A line of words that is long.\nSURVEY NUMBER: 12/B\nAnother line of words.\nVillage:\nKokapet is here.")], "doc_id int, text string")
    rows = E.rule_lines(docs, "doc_id", 2, ["survey", "village"]).collect()
    assert [(r.i, r.line_no, r.text, [a.text for a in r.ahead]) for r in rows] == [
        (1, 2, "SURVEY NUMBER: 12/B", ["Another line of words.", "Village:"]), (3, 4, "Village:", ["Kokapet is here."])]
    got = K.lookup(docs, {"survey_number": ["Survey No", "Survey Number"], "none": ["::"], "village": ["Village"]}).select("field_key", "value").collect()
    assert sorted(map(tuple, got)) == [("survey_number", "12/B"), ("village", "Kokapet is here.")]
