"""Labels and lines meet on a word; the plain-text check before the pattern loses none that the pattern would find."""

import re

from pyspark.sql import functions as F

from fieldloom.operators import label_search as L
from fieldloom.operators import rules as E

LINES = ["Owner Name : Asha", "OWNER NAME: x", "owner  name: two blanks", "name of owner", "Ownership name", "Straße Name: ä", "STRASSE NAME: b",
         "PlanK No. (old): 7", "plank no. (OLD) = 8", "", "owner name owner name: y", "é owner name - z", "a.b name: q", "aXb name: q"]
LABELS = ["owner name", "Name", "straße name", "Plank No. (old)", "a.b name"]


def test_pairs_equal_the_bare_pattern(spark):
    lines = spark.createDataFrame(list(enumerate(LINES)), "i int, text string")
    dim = L.label_dim(spark, LABELS)
    got = {(r.text, r.label) for r in L.anchor_join(lines, dim).filter(F.regexp_like("text", E.whole_label(F.col("label")))).collect()}
    # what the word join and the pattern alone give
    words = lambda t: set(re.findall(r"[^\W_]+", t.lower()))
    pairs = [(t, a) for t in LINES for a in LABELS if L.anchor_word(a) in words(t)]
    bare = spark.createDataFrame(pairs, "text string, label string").filter(F.regexp_like("text", E.whole_label(F.col("label"))))
    assert got == {(r.text, r.label) for r in bare.collect()}
    assert ("PlanK No. (old): 7", "Plank No. (old)") in got and ("OWNER NAME: x", "owner name") in got
    assert ("owner  name: two blanks", "owner name") not in got and ("aXb name: q", "a.b name") not in got


def test_pairs_with_many_labels_and_clashing_columns(spark):
    lines = spark.createDataFrame([(1, "alpha seven: 1", "x"), (2, None, "y")], "i int, text string, stop string")
    dim = spark.createDataFrame([("alpha seven", "seven"), ("seven eight", "seven")], "label string, anchor string")
    assert [(r.i, r.label, r.stop) for r in L.anchor_join(lines, dim).collect()] == [(1, "alpha seven", "x")]
