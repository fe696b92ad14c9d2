"""The whole analysis on small documents: sure values, ranked values, reasons, pages."""

from fieldloom.operators import analysis as A

TEXT = "Electric Meter Number: EM1234567\nTransformer ID - TR-999\nVillage: Kokapet\nPAN No: ABC"


def test_full_result_rows(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    line = "array<struct<text:string,box:array<array<double>>,confidence:double>>"
    pages = spark.createDataFrame([(1, p, [(x, None, 0.9)]) for p, x in enumerate(TEXT.split("\n"), 1)], f"doc_id long, page int, lines {line}")
    names = ["Electric Meter Number", "Transformer ID", "Owner Name", "Village", "PAN Number"]
    rows = A.analyse(docs, names, pages).collect()
    assert len(rows) == 3 * len(names)
    got = {r.field_name: r for r in rows if r.doc_id == 1}
    assert got["Electric Meter Number"].value == "EM1234567" and got["Transformer ID"].value == "TR-999" and got["Village"].value == "Kokapet"
    assert got["Electric Meter Number"].confidence > 60 and got["Village"].canonical_name == "village"
    assert got["Transformer ID"].source_line == 2 and got["Transformer ID"].source_page == 2
    missing = got["Owner Name"]
    assert (missing.value, missing.confidence, missing.source_method, missing.validation_error) == (None, 0, None, False)
    assert missing.reason is not None and missing.validation_message == missing.reason
    pan = got["PAN Number"]
    assert pan.value is None or (pan.validation_error and pan.confidence == 0 and pan.validation_message == "Field validation failed for PAN Number")
    for r in rows:
        if r.ranked_candidates:
            assert [c.rank for c in r.ranked_candidates] == list(range(1, len(r.ranked_candidates) + 1))
            assert r.explanation.endswith(r.ranked_candidates[0].explanation) and "semantic=" in r.explanation
        if r.doc_id > 1:
            assert r.value is None and r.confidence == 0 and r.reason == "No matching candidate found"
