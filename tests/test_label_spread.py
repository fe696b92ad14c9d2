"""Distinct labels are judged over all cores, with their trigrams hashed once."""

from pyspark.sql import functions as F

from fieldloom.functions import similarity as Sim
from fieldloom.operators import resolve as R

LABELS = ["Owner Name", " owner name ", "Ownar Name", "a", "", "  ", "aaaaaaaa", "Vide File No. 5/C3/TP of 12", "Survey Number", "Ünder ß", "x" * 80]
REQUESTS = ["Owner Name", "Survey Number", "PAN Number"]


def test_hashes_give_the_cosine_of_vectors(spark):
    rows = spark.createDataFrame([(a, b) for a in LABELS for b in REQUESTS], "a string, b string")
    va, vb = Sim.trigram_vector(F.col("a")), Sim.trigram_vector(F.col("b"))
    made = rows.select(va.alias("va"), vb.alias("vb"), Sim.trigram_hashes(F.col("a")).alias("hs")).withColumn("nb", F.sqrt(Sim.dot(F.col("vb"), F.col("vb"))))
    got = made.select(Sim.cosine01(F.col("vb"), F.col("va")).alias("want"), Sim.hashes_cosine01(F.col("vb"), F.col("nb"), F.col("hs"), Sim.hashes_norm(F.col("hs"))).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def test_few_labels_are_many_tasks(spark):
    labels = spark.createDataFrame([(x,) for x in LABELS], "label string")
    cores = spark.sparkContext.defaultParallelism
    assert R.distinct_labels(labels.unionAll(labels)).rdd.getNumPartitions() >= cores
    assert R.scored_pairs(labels, REQUESTS).rdd.getNumPartitions() >= cores


def test_exact_matches_are_those_of_the_gate(spark):
    cands = spark.createDataFrame([(i, x, "v") for i, x in enumerate(LABELS)], "doc_id int, label string, value string")
    want = cands.join(R.gated_pairs(cands, REQUESTS).filter("kind < 2"), "label")
    cols = ["doc_id", "label", "field_name", "field_ord", "kind"]
    got = R.exact_matches(cands, REQUESTS)
    assert got.count() == 3 and sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
