"""Ranked lexical search by a hybrid of term-at-a-time and document-at-a-time evaluation.

One pass over the texts writes a forward index of the query vocabulary (length, terms and frequencies of each document);
every later step reads only that. A task turns its documents into inverted lists. For a query the short lists are summed
term at a time into accumulators; these, sorted by document, then stand as one iterator with a bound of its own among the
long lists, and all of them are worked off document at a time, window by window: lists whose bounds together stay below the
score of the last document held are not walked, only looked up for documents that others bring, and a document falls out as
soon as what is left cannot lift it to that score.

Queries come in blocks of bounded vocabulary; a task keeps the best documents of each query of a block, so that what it
returns depends on the number of queries, not of documents. Everything is exact in 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import cut, hashed_words, text_blocks

TOP = 50
#: distinct terms of the queries of a block, about (a single query with more is a block of its own)
BLOCK_TERMS = 1 << 20
#: documents of a task that are inverted at once, and of these in a window
SHARD_DOCS, WINDOW_DOCS = 1 << 16, 1 << 12
#: lists of at most one document in so many are short
SHORT_SHARE = 64
#: parts into which the candidates of a query are dealt before the last selection
SALTS = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_terms(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of (first row, number of rows, row of each term, 64-bit hash of each term): runs of ASCII letters and
    digits and of all code points from U+0080 on, A-Z in lower case."""
    for first, end, data, offs in text_blocks(texts):
        _, _, row, h = hashed_words(_LOWER[data], offs, _TERM)
        yield first, end - first, row, h


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) for each document frequency."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The ``top`` best (score, document) pairs of one query so far: higher scores first, then smaller ids, null last."""

    __slots__ = ("top", "score", "doc", "null")

    def __init__(self, top: int):
        self.top = top
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def bar(self) -> int:
        """A document with less than this score cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        s, d, z = np.concatenate([self.score, score]), np.concatenate([self.doc, doc]), np.concatenate([self.null, null])
        order = np.lexsort((d, z, -s))[:self.top]
        self.score, self.doc, self.null = s[order], d[order], z[order]


def _summed(docs: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct documents and the sums of their values."""
    if len(docs) == 1:
        return docs[0], values[0]
    d, v = np.concatenate(docs), np.concatenate(values)
    order = np.argsort(d, kind="stable")
    d, v = d[order], v[order]
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.empty(0, np.int64)
    return d[start], np.add.reduceat(v, start) if len(d) else v


class Shard:
    """The inverted lists of some documents: for each term, documents in order of their ids, with impacts."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int):
        order = np.lexsort((doc, null))
        self.doc, self.null = doc[order], null[order]
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc))
        row = np.repeat(np.arange(len(doc)), np.diff(ends, prepend=0))
        m = 100 - 50 + (50 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[row])
        by = np.lexsort((place[row], term))
        self.at, self.impact, term = place[row][by], impact[by], term[by]
        self.terms, self.begin = np.unique(term, return_index=True)
        self.end = np.append(self.begin[1:], len(term))
        self.most = np.maximum.reduceat(self.impact, self.begin) if len(term) else self.impact

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Enter the documents of this shard that belong among the best for a query (terms, sorted, and their weights)."""
        k = np.searchsorted(self.terms, terms)
        there = np.flatnonzero((k < len(self.terms)) & (weight > 0))
        there = there[self.terms[k[there]] == terms[there]]
        if not len(there):
            return
        k, weight = k[there], weight[there]
        lists = [(self.at[self.begin[i]:self.end[i]], int(w) * self.impact[self.begin[i]:self.end[i]], int(w) * int(self.most[i]))
                 for i, w in zip(k.tolist(), weight.tolist(), strict=True)]
        longest = max(1, len(self.doc) // SHORT_SHARE)
        short, walks = [x for x in lists if len(x[0]) <= longest], [x for x in lists if len(x[0]) > longest]
        if short:
            # term at a time: the accumulators are one more list
            d, s = _summed([x[0] for x in short], [x[1] for x in short])
            walks.append((d, s, int(s.max())))
        walks.sort(key=lambda x: x[2])
        bounds = np.cumsum([x[2] for x in walks])
        reach = [np.searchsorted(x[0], np.arange(0, len(self.doc) + WINDOW_DOCS, WINDOW_DOCS)) for x in walks]
        for window in range(-(-len(self.doc) // WINDOW_DOCS)):
            bar = best.bar
            # lists before this one cannot lift a document to the bar, not even together
            needed = int(np.searchsorted(bounds, bar, "left"))
            if needed == len(walks):
                return
            parts = [(x[0][r[window]:r[window + 1]], x[1][r[window]:r[window + 1]]) for x, r in zip(walks[needed:], reach[needed:], strict=True)]
            parts = [p for p in parts if len(p[0])]
            if not parts:
                continue
            d, s = _summed([p[0] for p in parts], [p[1] for p in parts])
            for i in range(needed - 1, -1, -1):
                alive = s + bounds[i] >= bar
                d, s = d[alive], s[alive]
                if not len(d):
                    break
                own, values, r = walks[i][0], walks[i][1], reach[i]
                own, values = own[r[window]:r[window + 1]], values[r[window]:r[window + 1]]
                at = np.searchsorted(own, d)
                hit = np.flatnonzero(at < len(own))
                hit = hit[own[at[hit]] == d[hit]]
                s = s.copy()
                s[hit] += values[at[hit]]
            alive = s >= bar
            if alive.any():
                best.add(s[alive], self.doc[d[alive]], self.null[d[alive]])


def _forward(vocabulary):
    """doc_id, n (terms with repeats), and the terms of the vocabulary with their frequencies, for each text."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n_rows, row, h in text_terms(batch.column("text")):
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                known = words[at] == h
                both, tf = np.unique(row[known].astype(np.int64) << 32 | at[known], return_counts=True)
                ends = np.concatenate([[0], np.searchsorted(both >> 32, np.arange(n_rows), "right")]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (both & 0xFFFFFFFF, tf)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n_rows), pa.array(np.bincount(row, minlength=n_rows).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
    return index


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, count of documents with it, one row for each term of a task; term -1: documents with a term, and all terms."""
    df, n_docs, n_terms = np.zeros(0, np.int64), 0, 0
    for batch in batches:
        n, terms = batch.column("n").to_numpy(), batch.column("terms").flatten().to_numpy()
        n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        own = np.bincount(terms, minlength=len(df))
        own[:len(df)] += df
        df = own
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(df[some], n_docs)), pa.array(np.append(0 * some, n_terms))], ["term", "df", "n"])


def _searcher(shared, top: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_docs, n_terms = shared.value
        best = [Best(top) for _ in queries]
        held: list[pa.RecordBatch] = []

        def finish() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, terms = t.column("doc_id").combine_chunks(), t.column("terms").combine_chunks()
            ends = np.cumsum(pa.compute.list_value_length(terms).to_numpy(zero_copy_only=False)).astype(np.int64)
            shard = Shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), t.column("n").to_numpy(), ends,
                          terms.flatten().to_numpy().astype(np.int64), t.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64), n_docs, n_terms)
            for (words, weight), b in zip(queries, best, strict=True):
                shard.search(words, weight, b)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_DOCS:
                finish()
        if held:
            finish()
        for at in range(0, len(best), 1000):
            own = best[at:at + 1000]
            k = np.repeat(np.arange(at, at + len(own)), [len(b.score) for b in own]).astype(np.int32)
            ids = pa.array(np.concatenate([b.doc for b in own]), mask=np.concatenate([b.null for b in own]))
            yield pa.RecordBatch.from_arrays([pa.array(k), ids, pa.array(np.concatenate([b.score for b in own]))], ["k", "doc_id", "score"])
    return search


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n_rows, row, h in text_terms(batch.column("text")):
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            ends = np.concatenate([[0], np.searchsorted(row[new], np.arange(n_rows), "right")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(first, n_rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].view(np.int64)))], ["item_id", "terms"])


def top_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents with a score above 0 for each item.

    docs needs doc_id (a whole number) and text, items item_id and text; other columns are not read. Null, empty and blank
    texts have no terms: such documents count nowhere, such items return nothing. Equal scores rank by ascending doc_id,
    null last. Each row of docs is a document, also if it repeats another; equal rows of items (id and text) are one item, rows of
    equal id and different texts are items of their own. An empty table on either side gives an empty result. 50 * (terms of a
    document) * (number of documents) has to fit into 64 bits, as in the formula itself.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    distinct = items.select("item_id", "text").where("text is not null").distinct()
    hashed = cut(distinct.mapInArrow(_query_terms, f"item_id {kind.simpleString()}, terms array<long>").where("size(terms) > 0"), "queries")
    total = hashed.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-total // BLOCK_TERMS)
    out = None
    for block in range(blocks):
        # the queries of a block: about BLOCK_TERMS hashes at most
        own = hashed.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == block).toArrow().combine_chunks()
        if not own.num_rows:
            continue
        lists = own.column("terms").combine_chunks()
        words, term = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True)
        ends = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
        vocabulary = spark.sparkContext.broadcast(words)
        index = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forward(vocabulary), "doc_id long, n long, terms array<int>, tfs array<int>"), f"index{block}")
        known = index.mapInArrow(_frequencies, "term int, df long, n long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).toArrow().to_pydict()
        counts = dict(zip(known["term"], zip(known["df"], known["n"], strict=True), strict=True))
        n_docs, n_terms = counts.pop(-1, (0, 0))
        if not n_docs:
            continue
        df = np.zeros(len(words), np.int64)
        df[list(counts)] = [c[0] for c in counts.values()]
        weight = weights(df, n_docs)
        queries = [(np.sort(t), weight[np.sort(t)]) for t in np.split(term.astype(np.int64), ends[:-1])]
        found = index.mapInArrow(_searcher(spark.sparkContext.broadcast((queries, n_docs, n_terms)), top), "k int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        # what tasks have found meets in parts first, so that no query gathers all of it in one task
        for keys in (["k", "salt"], ["k"]):
            found = (found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
                     .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top))
        ids = spark.createDataFrame(pa.table({"k": pa.array(range(own.num_rows), pa.int32()), "item_id": own.column("item_id")}))
        part = found.join(F.broadcast(ids), "k").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out
