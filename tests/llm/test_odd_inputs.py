"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import decontam, language, line_rules, mixing, near_dup, secrets, sharding, surrogates, tokens, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, 1), (None, 1), (5, None), (2, 0)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench_dir(spark, tmp_path_factory):
    from invented import prose

    d = tmp_path_factory.mktemp("bench")
    spark.createDataFrame([(1, prose(77, 30)), (2, None), (None, "x y z"), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def operators(bench, labels):
    import public_tokenizers

    return {
        "sharding": lambda d: sharding.balanced_shards(sharding.narrow_documents(d)),
        "mixing": mixing.mix_documents,
        "line_rules": lambda d: line_rules.clean_lines(d, d.columns),
        "language": lambda d: language.languages(d, F.col("doc_id") > 0, d.columns),
        "near_dup": near_dup.near_duplicates,
        "decontam": lambda d: decontam.contaminated(d, bench),
        "decontaminated": lambda d: decontam.decontaminated(d, bench),
        "surrogates": surrogates.with_surrogates,
        "tokens": lambda d: tokens.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")),
        "toxicity": lambda d: toxicity.toxicity(d, labels, F.col("doc_id") > 0, d.columns),
        "secrets": secrets.credential_spans,
    }


ONE_ROW_EACH = {"sharding", "line_rules", "language", "near_dup", "decontaminated", "surrogates", "tokens", "toxicity", "secrets"}
NAMES = ["sharding", "mixing", "line_rules", "language", "near_dup", "decontam", "decontaminated", "surrogates", "tokens", "toxicity", "secrets"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd_docs, labels, bench_dir, name):
    out = operators(spark.read.parquet(f"{bench_dir}/benchmark.parquet"), labels)[name](odd_docs).collect()
    if name in ONE_ROW_EACH:
        assert sorted(str(r.doc_id) for r in out) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty_docs, labels, bench_dir, name):
    assert operators(spark.read.parquet(f"{bench_dir}/benchmark.parquet"), labels.where("false"))[name](empty_docs).count() == 0


@pytest.mark.parametrize("number", range(5))
def test_stages(spark, odd_docs, empty_docs, bench_dir, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd_docs, bench_dir)
    assert stage(spark, empty_docs, bench_dir).count() == 0
    if number < 4:
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    else:
        assert out.count() == odd_docs.count()


def test_repeated_rows_are_one_document(spark, odd_docs):
    kept = near_dup.first_of_groups(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and ids.count(2) == 0 and ids.count(None) == 2
