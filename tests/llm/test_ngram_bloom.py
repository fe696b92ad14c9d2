"""Language-model scores against plain counting, and the filter's levels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from invented import prose
from pyspark.sql import functions as F

from fieldloom.llm import ngram_bloom


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, prose(i % 40, 20 + i % 90)) for i in range(300)] + [(300, None), (301, ""), (302, " \t\n"), (303, "new word NEW"), (303, "new word NEW")]
    rows = [(i, t, i % 3) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n long"), rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


@pytest.mark.parametrize("known", [1 << 20, 5])
def test_base_and_model_score_match_plain_counts(spark, texts, known):
    docs, rows = texts
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    model = ngram_bloom.trained(docs, learn, known_words=known)
    got = {}
    for r in ngram_bloom.scored(docs, model, ["doc_id", "n"]).collect():
        got.setdefault(r.doc_id, []).append(r)
    train = [words(t) for i, t, _ in rows if zlib.crc32(str(i).encode()) % 10]
    c, pairs = Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t))
    n, v = sum(c.values()), len(c)
    assert (model.train_tokens, model.distinct) == (n, v)
    value = lambda k: float(ngram_bloom.VALUE[ngram_bloom.level(np.array([k]))][0])
    total, near = n + 0.1 * (v + 1), 0
    for i, t, k in rows:
        ws = words(t)
        base = sum(math.log10((c[w] + 0.1) / total) for w in ws)
        lm = 0.0
        for h, w in zip(["<s>", *ws], ws):
            ahead = value(c["</s>"] if h == "<s>" else c[h])
            pair = min(value(pairs[h, w]), value(c[w]), ahead)
            lm += math.log10((pair + ngram_bloom.PRIOR * (value(c[w]) + 0.1) / total) / (ahead + ngram_bloom.PRIOR))
        for r in got[i]:
            assert r.n == k and r.n_tokens == len(ws) and r.n_known == sum(c[w] > 0 for w in ws)
            assert r.base_score == pytest.approx(base, rel=1e-9)
            assert r.score >= lm - 1e-6
            near += abs(r.score - lm) < 1e-6 * max(1, abs(lm))
    assert near > 0.9 * len(rows)
    assert len(got[303]) == 2 and sum(map(len, got.values())) == len(rows)


def test_model_beats_the_word_counts_on_held_out_texts(spark, texts):
    docs, rows = texts
    r = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = ngram_bloom.scored(docs, ngram_bloom.trained(docs, r != 0), ["doc_id"]).where(r == 0).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > out.b


def test_a_full_filter_leaves_out_the_lowest_levels(spark, texts):
    docs, _ = texts
    small = ngram_bloom.trained(docs, F.lit(True), filter_bits=1 << 13)
    assert small.least_level > 1 and small.bits == ngram_bloom.LEAST_BITS
    assert ngram_bloom.scored(docs, small, ["doc_id"]).where("score > 0").count() == 0


def test_levels_come_back_from_the_filter():
    rng = np.random.default_rng(5)
    grams, counts = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), rng.zipf(1.5, 5000).clip(1, 1 << 40)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], ["gram", "n"])
    data = np.zeros((1 << ngram_bloom.SEGMENT_BITS, 1024 // 8), np.uint8)
    for part in ngram_bloom._united(ngram_bloom._filled(1024, 1)(iter([batch, batch]))):
        for s, b in zip(part.column("seg").to_pylist(), part.column("bits").to_pylist()):
            data[s] = np.frombuffer(b, np.uint8)
    found = ngram_bloom.Filter(data.ravel(), 1024).levels(grams)
    true = ngram_bloom.level(counts)
    assert (found >= true).all() and (found == true).mean() > 0.99


def test_nothing_learned_and_empty_tables(spark, odd_docs, empty_docs):
    none = ngram_bloom.trained(odd_docs, F.lit(False))
    assert none.train_tokens == 0
    assert [r.base_score for r in ngram_bloom.scored(odd_docs.where("text = ''"), none, ["doc_id"]).collect()] == [0.0]
    model = ngram_bloom.trained(odd_docs, F.col("doc_id") > 0)
    assert ngram_bloom.scored(empty_docs, model, ["doc_id"]).count() == 0
    assert ngram_bloom.scored(odd_docs, model, odd_docs.drop("text").columns).count() == odd_docs.count()
    assert ngram_bloom.trained(empty_docs, F.lit(True)).distinct == 0


@pytest.mark.parametrize(("known", "bits"), [(1 << 20, 1 << 13), (5, 1 << 13), (5, 1)])
def test_levels_that_a_full_filter_lacks_are_joined(spark, texts, known, bits):
    docs, rows = texts
    learn = F.col("doc_id") % 10 != 0
    whole, small = ngram_bloom.trained(docs, learn), ngram_bloom.trained(docs, learn, filter_bits=bits, known_words=known)
    assert whole.least_level == 1 and small.least_level > 1
    of = lambda m: sorted(tuple(r) for r in ngram_bloom.scored(docs, m, ["doc_id", "n"]).collect())
    want, got = of(whole), of(small)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == len(rows)
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], rel=1e-9)
    # a false positive of a filter counts an n-gram a little higher
    assert sum(abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) for a, b in zip(got, want)) > 0.9 * len(rows)
