"""Golden cases of the rule cascade, label search, similarity, ranking and resolution."""

import random

from pyspark.sql import functions as F

from fieldloom.functions.similarity import lcs_ratio
from fieldloom.operators import label_search as L
from fieldloom.operators import resolve as R
from fieldloom.operators import rules as E


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


def test_lcs_ratio_against_brute_force():
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 90)))
        b = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 90)))
        assert abs(lcs_ratio(a, b) - 2 * brute_lcs(a, b) / (len(a) + len(b))) < 1e-12
    assert abs(lcs_ratio("name owner", "name of owner") - 20 / 23) < 1e-12
    assert abs(lcs_ratio("numbir pam", "number pan") - 0.8) < 1e-12


def test_cascade_golden(spark):
    d = docs(
        spark, "| Field | Value |\n| --- | --- |\n| PAN No | ABCDE1234F |\n", "PAM Numbir - XYZ", "Inspection Date: 17/02/2026",
        "some text inspection_date some other 24-06-2026 text", "Owner Name:\nJohn Doe\nVillage: X",
        "Property Description:\nLine one\nLine two\nVillage: Bhanoor",
        "North: Corridor.\nBounded on South by: Open to sky\nEast: 30 Feet Wide Road\nWest: Plot 10")
    keys = ["pan_number", "inspection_date", "name_of_the_owner_s", "property_description", "boundaries_north", "boundaries_east", "boundaries_west"]
    got = {(r.doc_id, r.field_key): (r.value, r.match_type) for r in E.cascade(d, keys).collect()}
    assert got[0, "pan_number"] == ("ABCDE1234F", "table")
    assert got[1, "pan_number"] == ("XYZ", "fuzzy")
    assert got[2, "inspection_date"] == ("17/02/2026", "same_line")
    assert got[3, "inspection_date"] == ("24-06-2026", "regex")
    assert got[4, "name_of_the_owner_s"] == ("John Doe", "next_line")
    assert got[6, "boundaries_north"] == ("Corridor.", "boundary")
    assert got[6, "boundaries_east"] == ("30 Feet Wide Road", "boundary")
    assert got[6, "boundaries_west"] == ("Plot 10", "boundary")
    # a next line wins over the multi-line rule, which is the later one
    assert got[5, "property_description"] == ("Line one", "next_line")


def test_multiline_stops_at_another_label(spark):
    d = docs(spark, "Property Description: flat\nFlat 502, Towers,\nHyderabad\nSurvey No: 5")
    dim = E.field_labels(spark, ["property_description"])
    rows = E.multiline_rule(E.label_hits(E.rule_lines(d), dim), dim, E.stop_labels(spark, ["Survey No"]))
    v = rows.collect()[0].value
    assert "Flat 502, Towers" in v and "Hyderabad" in v and "Survey" not in v


def test_same_line_separators(spark):
    d = docs(spark, "Age - 35", "Age = 35", "Age: 35", "Age:", "Limit (Age 35)")
    dim = E.field_labels(spark, ["age"], {"age": ["Age"]})
    got = {r.doc_id: r.value for r in E.same_line_rule(E.label_hits(E.rule_lines(d), dim)).collect()}
    assert got == {0: "35", 1: "35", 2: "35"}


def test_label_search(spark):
    lines = L.with_following(docs(spark, "Owner Name: John Doe\nowner name: Jane Doe", "Owner Name | John Doe"))
    dim = L.label_dim(spark, ["Owner Name"])
    exact, loose = L.search_inline(lines, dim, True), L.search_inline(lines, dim, False)
    assert [r.value for r in exact.filter("doc_id = 0").collect()] == ["John Doe"]
    assert [r.value for r in loose.filter("doc_id = 0").orderBy("source_line").collect()] == ["John Doe", "Jane Doe"]
    assert [r.value for r in L.search_table(lines, dim).collect()] == ["John Doe"]
    best = L.priority_pick(exact.unionByName(loose).filter("doc_id = 0"), ["doc_id"]).collect()[0]
    assert (best.value, best.strategy) == ("John Doe", "Exact")


def test_resolution(spark):
    d = docs(spark, "Some unrelated text\nElectric Meter Number: EM-999\nAnother text", "Owner Name: Pavan Kumar\nElectric Meter Number: 123456")
    names = ["Electric Meter Number", "Owner Name", "GST Number"]
    got = {(r.doc_id, r.field_name): r for r in R.resolve(d, names).collect()}
    assert len(got) == 6
    assert got[0, "Electric Meter Number"].value == "EM-999" and got[0, "Electric Meter Number"].strategy == "Exact"
    assert got[1, "Owner Name"].value == "Pavan Kumar"
    gst = got[0, "GST Number"]
    assert gst.value is None and gst.confidence == 0.0 and gst.needs_review
    assert all(0.0 <= r.confidence <= 1.0 for r in got.values())


def test_context_score(spark):
    text = "Title\nSurvey Number: 123\nVillage: Bhanoor\nOwner Name: John Doe\nDate of Agreement: 2026-01-01\nTotal Amount: 50000\n"
    names = ["Survey Number", "Village", "Owner Name", "Date of Agreement", "Total Amount"]
    near = {r.source_line: r.near for r in R.neighbour_requests(docs(spark, text), names).collect()}
    assert len([x for x in near[4] if x != "owner name"]) == 4


def test_validation_score(spark):
    rows = [("Email Address", "test@example.com", 1.0), ("Email Address", "invalid-email", 0.0), ("Phone Number", "+91 98765 43210", 1.0),
            ("Mobile", "123", 0.0), ("Agreement Date", "25/12/2025", 1.0), ("Date", "not-a-date", 0.0), ("Aadhaar Number", "1234 5678 9012", 1.0),
            ("Aadhar", "1234 5678", 0.0), ("PAN Card", "ABCDE1234F", 1.0), ("PAN", "ABC1234F", 0.0), ("Random Field", "Any Value", 1.0)]
    df = spark.createDataFrame(rows, "q string, v string, want double")
    assert all(r.got == r.want for r in df.withColumn("got", R.validation_score(F.col("q"), F.col("v"))).collect())


def test_vector_index_loses_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 12))
    vecs = np.concatenate([centres[rng.integers(0, 6, 300)] + rng.normal(scale=0.35, size=(300, 12)), np.zeros((2, 12)), np.repeat(centres[:1], 3, 0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, vec array<double>")
    req = df.selectExpr("vec_id as request_id", "vec as request_vec")
    n = np.linalg.norm(vecs, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = np.nan_to_num((vecs @ vecs.T / np.outer(n, n) + 1) / 2)
    for threshold in (0.6, 0.85, 0.97):
        want = {(i, j) for i in range(len(vecs)) for j in range(len(vecs)) if i != j and n[i] and n[j] and sim[i, j] >= threshold}
        got = R.vector_join(req, df, threshold).select("request_id", "vec_id").collect()
        assert len(got) == len(want) > 0 and {tuple(r) for r in got} == want
    met = R.vector_join(req, df, 0.97)
    assert "NestedLoop" not in met._jdf.queryExecution().executedPlan().toString()
    assert R.vector_join(req, df.where("vec_id in (300, 301)"), 0.5).count() == 0 and R.vector_join(req, df.where("false"), 0.5).count() == 0


def test_vectors_meet_in_cells(spark):
    rows = [(i, [1.0, float(i % 3)], "x") for i in range(40)] + [(40, [1.0, None], "y"), (41, [2.0, 0.0, 0.0], "z"), (42, None, "n")]
    df = spark.createDataFrame(rows, "vec_id long, vec array<float>, kind string")
    req = df.where("vec_id % 20 = 0 or vec_id = 41").selectExpr("vec_id as request_id", "vec as request_vec", "kind as asked")
    met = R.vector_join(req, df, 0.999, side=7)
    assert set(met.columns) == {"request_id", "asked", "vec_id", "kind", "similarity"}
    got = {(r.request_id, r.vec_id) for r in met.collect()}
    assert got == {(i, j) for i in (0, 20) for j in range(40) if i != j and i % 3 == j % 3} and met.count() == len(got)
    # the cells are dealt by a key of their own, not by where vectors lie: one row for each pair, no vector in it
    assert "FlatMapGroupsInArrow" in met._jdf.queryExecution().executedPlan().toString()
