"""Golden cases: parties that stand close together, a seventh address line, alias tables of any size, labels inside lines."""

from pyspark.sql import functions as F

from fieldloom.operators import derive as V
from fieldloom.operators import lookup as K
from fieldloom.operators import rules as E
from fieldloom.streaming import incremental as J


def test_three_parties_share_the_text_behind_them(spark):
    t = ("Between 1) Mr. Ravi Kumar S/o Gopal Rao, 2) Smt. Lakshmi Devi W/o Ravi Kumar, 3) Mr. Arun Varma S/o Hari Varma, the VENDEE. "
         "Resident of Flat 3, Kokapet Hereinafter the purchaser. Phone 9876543210")
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = df.select(V.party_profiles(F.col("text")).alias("p")).select("p", V.pick_buyer(F.col("p"), F.lit(None).cast("string")).alias("b")).first()
    assert [p.raw_name for p in r.p] == ["Ravi Kumar", "Lakshmi Devi", "Arun Varma"] and {p.role for p in r.p} == {"buyer"}
    assert {p.address for p in r.p} == {"Flat 3, Kokapet"} and {p.phone for p in r.p} == {"9876543210"}
    assert r.b.raw_name == "Ravi Kumar"


def test_seventh_address_line_is_taken(spark):
    lines = ["Property Address", "12-3, Main Road", "Second Road Colony", "Third Lane Colony", "Fourth Colony Road", "Fifth Nagar Road", "Sixth Village Road",
             "Seventh Mandal Road", "Eighth District 500001"]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = K.lookup(df, {"property_address": ["Property Address"]}).first()
    assert "Seventh Mandal Road" in got.value and "Eighth District 500001" in got.value


def test_alias_table_has_no_cap(spark, tmp_path):
    path = str(tmp_path / "aliases")
    spark.range(60_000).select(F.lit(0).alias("dict_rank"), F.lit("order_code").alias("field_key"), F.lit(0).alias("key_rank"),
                               F.concat(F.lit("Filler Label "), F.col("id")).alias("alias"), F.col("id").cast("int").alias("alias_rank")).union(
        spark.createDataFrame([(0, "order_code", 0, "Zebra Mark", 60_000)], "dict_rank int, field_key string, key_rank int, alias string, alias_rank int")).write.parquet(path)
    labels = E.field_labels(spark, ["order_code", "lone_key"], alias_path=path)
    assert labels.where("field_key = 'order_code'").count() == 60_001
    assert [tuple(r) for r in labels.where("field_key = 'lone_key'").collect()] == [("lone_key", "Lone Key", 0, "lone")]
    docs = spark.createDataFrame([(1, "Zebra Mark: AB12"), (2, "nothing here")], "doc_id long, text string")
    got = E.cascade(docs, ["order_code"], alias_path=path, stops=["Unused Stop"]).select("doc_id", "value").collect()
    assert [tuple(r) for r in got] == [(1, "AB12")]


def test_label_inside_a_line(spark):
    docs = spark.createDataFrame([(1, "xxPlotSize 40\nother"), (2, "no")], "doc_id long, text string")
    lines = E.rule_lines(docs)
    dim = E.field_labels(spark, ["plot"], {"plot": ["PlotSize", "Pl"]})
    open_fields = docs.select("doc_id", F.lit("plot").alias("field_key"))
    assert [(r.doc_id, r.value) for r in E.contains_rule(lines, open_fields, dim).collect()] == [(1, "40")]


def test_streams_need_a_shared_folder_on_a_cluster(spark):
    assert J.work_folder(spark, "x").startswith("/")
