"""d8_vector_pairs: every vector is a request, and near pairs of single precision are settled in double precision."""

import math

import __spark_entry__ as entry
from fieldloom.operators import resolve as R

DIR = "/root/testdata/sf0.001"


def test_every_vector_asks(spark):
    assert "%" not in entry.oracle_sql()["d8_vector_pairs"]
    got = entry.queries()["d8_vector_pairs"](spark, DIR).collect()
    pairs = {(r.request_id, r.vec_id): r.similarity for r in got}
    assert pairs and {(b, a): s for (a, b), s in pairs.items()} == pairs
    assert any(a % 20 for a, _ in pairs)


def test_threshold_in_double_precision(spark):
    # mapped cosines that differ from the threshold by less than single precision tells apart
    steps = [-3e-9, -1e-9, 1e-9, 3e-9]
    rows = [(i, [0.4 + s, math.sqrt(1 - (0.4 + s) ** 2)]) for i, s in enumerate(steps)] + [(9, [1.0, 0.0])]
    vecs = spark.createDataFrame(rows, "vec_id int, vec array<double>")
    req = vecs.where("vec_id = 9").selectExpr("vec_id as request_id", "vec as request_vec")
    assert sorted(r.vec_id for r in R.vector_join(req, vecs, 0.7).collect()) == [2, 3]
