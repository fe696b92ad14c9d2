"""The paths without patterns (plain lines, plain labels) against the patterns themselves."""

from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import discovery as D
from fieldloom.operators import label_search as L
from fieldloom.operators import rules as E

TEXTS = ["", "\n", "a", "a\n", "a\n\n", "\na", "a\r\nb\r\n", "a\rb", "a\x0bb\x1c", "a b\n", "é\nü\n", " x \n\n y", None]


def test_lines_with_and_without_patterns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.split_lines(F.col("t")).alias("x")).collect()}
    assert got == {i: (t or "").splitlines() for i, t in enumerate(TEXTS)}


def test_whole_words_with_and_without_patterns(spark):
    labels = ["Village", "No.", "D.No.", "S", "(a)", "Owner Name", "Dörf"]
    texts = ["Village: x", "Villages: x", "villages, VILLAGE - y", "No.5", "No. 5", "D.No. 7", "H.D.No.7", "Ss S = 4", "(a) b", "x(a)b", "Owner Name", "Owner Name::z",
             "Dörf: z", "dörfer DÖRF z", "Village é", "_S S_ 1"]
    df = spark.createDataFrame([(t, a) for t in texts for a in labels], "t string, a string")
    for case_sensitive, bare in ((False, False), (True, False), (False, True)):
        pattern = E.whole_label(F.col("a")) if bare else L.whole_word(F.col("a"), case_sensitive)
        at = L.whole_at(F.col("t"), F.col("a"), case_sensitive, bare)
        rows = df.select("t", "a", at.alias("at"), F.regexp_like("t", pattern).alias("p"), F.get(F.split("t", pattern, 2), F.lit(0)).alias("before")).collect()
        assert all(r["at"] is None or (r["at"] > 0) == r["p"] for r in rows)
        assert all(r["before"] == r["t"][:r["at"] - 1] for r in rows if r["at"])
        assert sum(r["at"] is not None for r in rows) > len(rows) / 2


def test_stopwords_and_fragments_of_any_case(spark):
    df = spark.createDataFrame([("Owner", "TO"), ("Owner", "x BETWEEN:-"), ("Which", "yy"), ("Owner", "x At the Time of Registration."), ("Owner", "Rao.")], "l string, v string")
    got = [r.r for r in df.select(D.reject_reason(F.col("l"), F.col("v")).alias("r")).collect()]
    assert got == ["stopword", "fragment", "stopword", "fragment", None]
