"""The work list of an outside model and the merge of its answers."""

from fieldloom.operators import label_search as L

RESOLVED = "doc_id long, field_name string, value string, confidence double, reason string, fuzzy double"


def resolved(spark):
    rows = [(1, "Plot No.", None, 0.0, "none", None), (1, "Owner", "Asha", 0.9, None, 0.8), (1, "Phone", None, 0.0, "low", 0.4),
            (2, "Plot No.", None, 0.0, "none", None), (3, "Plot No.", None, 0.0, "none", None), (4, "Colour", None, 0.0, "none", None)]
    return spark.createDataFrame(rows, RESOLVED)


def test_requests_carry_keywords_and_the_text_around_them(spark):
    long_text = "\n".join(["head"] + ["filler"] * 60 + ["PLOT number 7"] + ["tail"] * 60)
    docs = spark.createDataFrame([(1, long_text), (2, None), (3, ""), (4, "no hit\nat all")], "doc_id long, text string")
    words = spark.createDataFrame([("Plot No.", "Plot Number"), ("Plot No.", "Plot No."), ("Plot No.", " ")], "field_name string, alias string")
    queue = L.fallback_queue(resolved(spark))
    got = {r.request_id: r for r in L.work_list(queue.unionAll(queue), docs, words).collect()}
    assert sorted(got) == ["1:plot_no", "4:colour"]
    one = got["1:plot_no"]
    assert one.keywords == ["Plot No.", "Plot Number"] and one.label == "Plot No." and one.answer_confidence == 0.85
    lines = one.chunk.split("\n")
    assert "PLOT number 7" in lines and "head" not in lines and lines[0] == "... [gap] ..."
    assert got["4:colour"].keywords == ["Colour"] and got["4:colour"].chunk == "no hit\nat all"


def test_answers_fill_open_fields_once(spark):
    said = spark.createDataFrame([("1:plot_no", " "), ("1:plot_no", "12"), ("1:plot_no", "12"), ("1:owner", "Other"), ("2:plot_no", None), ("9:x", "y")],
                                 "request_id string, answer string")
    got = {(r.doc_id, r.field_name): (r.value, r.confidence, r.reason) for r in L.merge_answers(resolved(spark), said).collect()}
    assert len(got) == 6 and L.merge_answers(resolved(spark), said).count() == 6
    assert got[1, "Plot No."] == ("12", 0.85, None) and got[1, "Owner"] == ("Asha", 0.9, None)
    assert got[2, "Plot No."] == (None, 0.0, "none")
    assert L.merge_answers(resolved(spark), said.limit(0)).count() == 6
