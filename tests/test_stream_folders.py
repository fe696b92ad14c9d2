"""Streams of tables that are folders of files."""

from fieldloom.plans import stream_queries as Q

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tables_in_many_files(spark, tmp_path):
    for name in ("documents", "events"):
        spark.read.parquet(f"{DIR}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("j1_stream_candidates", "j3_latest_corrections"):
        got = rows(Q.QUERIES[name](spark, str(tmp_path)))
        assert got and got == rows(Q.QUERIES[name](spark, DIR))
