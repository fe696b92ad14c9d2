"""Golden cases of cleaners, validators, layout folds and text preparation."""

from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import derive as V
from fieldloom.operators import layout as B
from fieldloom.operators import numbers as N
from fieldloom.operators import templates as G


def column(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_cleaners(spark):
    assert column(spark, ["Mr. John Doe", "Mrs. Jane Smith", "sri RAMA RAO", "Dr.  B.R. Ambedkar"], V.clean_name) == [
        "John Doe", "Jane Smith", "Rama Rao", "B.R. Ambedkar"]
    assert column(spark, ["Line 1\nLine 2,\n\nLine 3"], V.clean_address_list) == ["Line 1, Line 2, Line 3"]
    assert column(spark, ["  hello   world  "], V.clean_generic) == ["hello world"]
    assert column(spark, ["h no. 12-3,   flat no. 502,, road 12,, village, mandal", "d no 5-10, plot no 12"], V.clean_address) == [
        "H.No. 12-3, Flat No. 502, road 12, village, mandal", "Door No. 5-10, Plot No. 12"]


def test_validators(spark):
    rows = [("inspection_date", "17-02-2026", True), ("inspection_date", "17/02/2026", True), ("inspection_date", "2026-02-17", True),
            ("inspection_date", "not a date", False), ("inspection_date", "31/31/2026", False), ("pan_number", "abcde1234f", True), ("pan_number", "ABC1234", False),
            ("aadhar_number", "1234 5678 9012", True), ("aadhar_number", "12345", False), ("cell_number", "+91 8765432109", True),
            ("cell_number", "12345", False), ("pincode", "500089", True), ("pincode", "50008", False), ("survey_no", "90/A", True), ("survey_no", "1", False)]
    df = spark.createDataFrame(rows, "k string, v string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", V.is_valid(F.col("k"), F.col("v"))).collect())


def test_area(spark):
    df = spark.createDataFrame([("100 Sq Yds", ""), ("10 sq mtrs", ""), ("1,200 sft", ""), ("50", "plot of 50 gaj"), ("50", "GHMC sheet"), ("none", "")], "v string, c string")
    got = [r.a for r in df.select(V.convert_area(F.col("v"), F.col("c")).alias("a")).collect()]
    assert [(round(a.sqft, 2), round(a.sqyd, 2)) if a else None for a in got] == [(900.0, 100.0), (107.64, 11.96), (1200.0, 133.33), (450.0, 50.0), (538.19, 59.8), None]


def test_wrapped_lines(spark):
    cases = [("12345678901234\nNext Line", "12345678901234 Next Line"), ("123456789012345\nNext Line", "123456789012345\nNext Line"),
             ("a line that ends with,\n\nNext", "a line that ends with, Next"), ("a line long enough here\nwrapped", "a line long enough here wrapped"),
             ("A\nB\nC\nD\nE\nF\nG\nH\nI", "A B C D E F G H\nI"), ("", ""), ("\n \n", ""), (None, None), ("Only", "Only")]
    assert column(spark, [c[0] for c in cases], B.merge_wrapped) == [c[1] for c in cases]
    # more lines than one step of the fold takes
    long = "\n".join(f"Sentence number {k} is whole" if k % 3 else "and goes on" for k in range(1, 20_001))
    want = []
    for k in range(1, 20_001):
        want.append(f"Sentence number {k} is whole") if k % 3 else want.append(want.pop() + " and goes on")
    assert column(spark, [long], B.merge_wrapped) == ["\n".join(want)]


def box(x, y, w=50, h=10):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]


def markdown(spark, *pages):
    df = spark.createDataFrame([(list(p),) for p in pages], "lines array<struct<text:string,box:array<array<double>>,confidence:double>>")
    return [r.text for r in B.reconstruct_pages(df).collect()]


def test_layout(spark):
    line = lambda t, x, y, w=50.0, h=10.0: {"text": t, "box": [[float(a), float(b)] for a, b in box(x, y, w, h)], "confidence": 1.0}
    page = [line("Value", 100, 1), line("Item", 0, 0), line("B", 100, 20), line("A", 0, 25), line("SCHEDULE A", 0, 60), line("end", 0, 80)]
    rows = [line("b", 50, 6), line("a", 0, 0)]
    near = [line("a", 50, 0), line("b", 0, 5.9)]
    anchored = [line("a", 0, 0), line("b", 50, 5), line("c", 90, 10)]
    flat = [line("a|b", 0, 0, 50, 0), line("c", 50, 8.9, 50, 0), line("d", 0, 18, 50, 0)]
    plain = [{"text": "x", "box": [], "confidence": 1.0}, {"text": "y", "box": None, "confidence": 1.0}]
    mixed = [{"text": " x ", "box": None, "confidence": 1.0}, line("y", 0, 40), line("  ", 0, 50)]
    got = markdown(spark, page, rows, near, anchored, flat, plain, mixed, [])
    assert got[0] == "\n| Item | Value |\n| --- | --- |\n| A | B |\n\n\n## SCHEDULE A\n\nend"
    # exactly 0.6 of the height is a new row, and the height counts from the first line of the row
    assert got[1] == "a\nb" and got[2] == "\n| b | a |\n| --- | --- |\n" and got[3] == "\n| a | b |\n| --- | --- |\n\nc"
    assert got[4] == "\n| a|b | c |\n| --- | --- | --- |\n\nd" and got[5] == "x\ny" and got[6] == "x\ny" and got[7] == ""


def test_text_cleaning(spark):
    got = column(spark, ["a​b  c\t d\r\n|\n\n\n\nx ", "-\n_\nrow", None], B.clean_text)
    assert got == ["ab c d\n\nx", "row", ""]


def test_long_runs_do_not_end_the_engine(spark):
    n = 100_000
    assert column(spark, ["|\n" * n + "abc", "|\n" * n, "a" + "\n-" * n], B.clean_text) == ["abc", "", "a"]
    commas = ["a" + "," * n + "b", "a" + " ,\t" * n + "b"]
    for clean in (V.clean_address_list, V.clean_generic, V.clean_address):
        assert column(spark, commas, clean) == ["a, b", "a, b"]


def test_lines_and_title(spark):
    assert column(spark, ["a\nb\n", "", "a\r\n\x0bb", "\n"], T.split_lines) == [["a", "b"], [], ["a", "", "b"], [""]]
    assert column(spark, ["b.r. ambedkar", "o'neil x1y"], T.title_case) == ["B.R. Ambedkar", "O'Neil X1Y"]


def test_numbers(spark):
    assert column(spark, ["PERMIT No. 12/C3/TP123", "nothing here", "file no of 11.03.2024 is AB/22/X9"], N.permit_number)[:2] == ["12/C3/TP123", None]


def test_render(spark):
    df = spark.createDataFrame([("{{ab}} {{a}} {{zz}}", [("a", "1"), ("ab", "2")])], "t string, v array<struct<name:string,value:string>>")
    assert df.select(G.render(F.col("t"), F.col("v")).alias("x")).first().x == "2 1 {{zz}}"
