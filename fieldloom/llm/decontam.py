"""Benchmark decontamination: pairs of neighbouring words find passages, local alignment decides.

Words are runs of letters, digits and marks of any script, in lower case; in scripts that are written without blanks every
letter with its marks is a word. A document holds a copy of an item of L words if a local alignment of
words (match 2, mismatch and gap -1) reaches min_score * 2 * L, and at least 2 * GRAM; items of fewer words than GRAM stand
in a document only whole (items that are no passage, such as single words, are better left out by the caller). No such copy is lost before the
alignment: in an alignment of m matches and e errors, two matches in sequence with no error between them are a pair of
neighbours on both sides, those with one error a pair at distance 1 or 2 on each side, all others have two errors or more;
so score = 2m - e gives 2 * (pairs without error) + (pairs with one) >= score - 2. For each block of test items one
pass over the documents counts in how many of them each pair stands. The most common quarter (of this sum) of an item's
pairs is left out and taken off the sum that its others must reach. A second pass adds up the pairs of each document, first
in all of it, then in a window of the length that such an alignment can have, and aligns what reaches the sum.
Documents are never shuffled. Items come in blocks of at most BLOCK_GRAMS pairs (24 MB with positions), so that what tasks
hold is bounded; more blocks mean more passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .base import _mixed, cut, hashed_runs, text_blocks

GRAM = 3
LEFT_OUT = 4
BLOCK_GRAMS = 1_000_000
MIN_SCORE = 0.5
GAPS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1

# ---- fixed values: blocks of scripts that are written without blanks between words (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han)
NO_BLANKS = [(0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
             (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
# -------------------------------------------------------------------------------------------

_ASCII = np.zeros(256, bool)
_ASCII[[*range(48, 58), *range(97, 123)]] = True
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """For each code point: 0 not of a word, 1 of a word, 2 a word of its own."""
    if not _KINDS:
        kind = np.zeros(0x110000, np.uint8)
        for first in (0, 0x20000):  # no letters between, and none behind U+3FFFF but tags
            at = range(first, first + 0x20000)
            kind[first:first + 0x20000] = [unicodedata.category(chr(c))[0] in "LNM" for c in at]
        for a, b in NO_BLANKS:
            letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(a, b + 1)), bool, b + 1 - a)
            kind[a:b + 1][letters] = 2
        _KINDS.append(kind)
    return _KINDS[0]


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """For each byte of UTF-8 whether it belongs to a word, and where words begin in any case."""
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return _ASCII[data], None
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    point = (data[lead] & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint8)[size]).astype(np.int64)
    for k in (1, 2, 3):
        more = size > k
        point[more] = point[more] << 6 | data[np.minimum(lead[more] + k, len(data) - 1)] & 0x3F
    kind = _kinds()[np.minimum(point, 0x10FFFF)]
    flag, begins = _ASCII[data], np.zeros(len(data), bool)
    for k in range(4):
        at = lead[size > k] + k
        flag[at[at < len(data)]] = (kind[size > k] > 0)[at < len(data)]
    own = kind == 2
    begins[lead[own]] = True
    # what follows a word of its own begins anew, marks apart
    after = (lead + size)[own]
    after = after[after < len(data)]
    ascii_after = after[_ASCII[data[after]]]
    begins[ascii_after] = True
    letters = lead[kind == 1]
    marks = np.fromiter((unicodedata.category(chr(p))[0] == "M" for p in point[kind == 1].tolist()), bool, len(letters)) if own.any() else np.ones(len(letters), bool)
    begins[np.intersect1d(letters[~marks], after)] = True
    return flag, begins


def _words(texts: pa.Array):
    """Blocks of (first row, end row, word rows, word hashes)."""
    for first, end, data, offs in text_blocks(pc.utf8_lower(texts)):
        _, _, row, h = hashed_runs(data, offs, *_runs(data))
        yield first, end, row, h


def _pairs(row: np.ndarray, h: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word and the word ``gap`` behind it, and whether that one is in the same text; gap 0: of the word."""
    if not gap:
        return _mixed(~h), np.ones(len(h), bool)
    n = max(0, len(h) - gap)
    pair, whole = np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
    with np.errstate(over="ignore"):
        pair[:n] = _mixed(_mixed(h[:n] * np.uint64(0x9E3779B97F4A7C15)) + h[len(h) - n:])
    whole[:n] = row[:n] == row[len(h) - n:]
    return pair, whole


class Grams:
    """Sorted hashes with a small table in front, so that most lookups end there."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.unique(hashes)
        self.front = np.zeros(1 << 22, bool)
        self.front[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def found(self, gram: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """Positions whose gram is among the hashes."""
        at = np.flatnonzero(self.front[(gram >> np.uint64(42)).astype(np.int64)] & whole)
        k = np.searchsorted(self.hashes, gram[at])
        return at[self.hashes[np.minimum(k, len(self.hashes) - 1)] == gram[at]]


def item_grams(benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """item_id, n (words), words (array of hashes, once), pos, gap (1 or 2) and gram (hash) for each pair of words of each item
    (item_id, text) with a word; a single word has gap 0."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, row, h in _words(batch.column("text")):
                ids = batch.column("item_id").slice(first, end - first).to_pylist()
                begin = np.searchsorted(row, np.arange(end - first + 1))
                for r, item in enumerate(ids):
                    own = h[begin[r]:begin[r + 1]]
                    for gap in (0,) if len(own) == 1 else GAPS:
                        pair, whole = _pairs(np.zeros(len(own), int), own, gap)
                        at = np.flatnonzero(whole)
                        if len(at):
                            words = [own.view(np.int64) if gap < 2 else None] + [None] * (len(at) - 1)
                            yield pa.RecordBatch.from_pydict({
                                "item_id": pa.array([item] * len(at), pa.int64()), "n": pa.array([len(own)] * len(at), pa.int64()),
                                "words": pa.array(words, pa.list_(pa.int64())), "pos": pa.array(at, pa.int64()),
                                "gap": pa.array([gap] * len(at), pa.int64()), "gram": pa.array(pair[at].view(np.int64))})

    return benchmark.where("item_id is not null and text is not null").select("item_id", "text").mapInArrow(
        grams, "item_id long, n long, words array<long>, pos long, gap long, gram long")


def document_frequency(docs: DataFrame, grams: np.ndarray) -> DataFrame:
    """gram, df: the number of documents that hold each of the given pairs, at distance 1 or 2."""
    wanted = docs.sparkSession.sparkContext.broadcast(grams)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Grams(wanted.value)
        total = np.zeros(len(table.hashes), np.int64)
        for batch in batches:
            for _, _, row, h in _words(batch.column("text")):
                seen = []
                for gap in (0, *GAPS):
                    pair, whole = _pairs(row, h, gap)
                    at = table.found(pair, whole)
                    seen.append(row[at] * len(table.hashes) + np.searchsorted(table.hashes, pair[at]))
                total += np.bincount(np.unique(np.concatenate(seen)) % len(table.hashes), minlength=len(table.hashes))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": pa.array(table.hashes[seen].view(np.int64)), "df": pa.array(total[seen])})

    return docs.select("text").mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Best local alignment of two word sequences: score, end of it in b. Gaps are linear, so that a running maximum
    along each row replaces the inner loop."""
    steps = np.arange(1, len(b) + 1) * -GAP
    h = np.zeros(len(b) + 1, np.int64)
    best, end = 0, 0
    for w in a:
        t = np.maximum(np.maximum(h[:-1] + np.where(b == w, MATCH, MISMATCH), h[1:] + GAP), 0)
        t = np.maximum.accumulate(t + steps) - steps
        h[1:] = t
        k = int(t.argmax())
        if t[k] > best:
            best, end = int(t[k]), k + 1
    return best, end


def _needed(n, gram: int, min_score: float):
    """The least score of an alignment that makes a copy of an item of n words."""
    return np.maximum(np.ceil(min_score * MATCH * n - 1e-9).astype(int), MATCH * np.minimum(gram, n))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins (sorted arrays)."""
    first = np.ones(len(keys[0]), bool)
    if len(first):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first


class Seeds:
    """What a task needs of a block of items: their words, and the pairs sorted by hash."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, pos: np.ndarray, gap: np.ndarray, words: dict[int, np.ndarray], least: int, min_score: float) -> None:
        order = np.argsort(gram, kind="stable")
        self.ids = np.array(sorted(words), np.int64)
        self.gram, self.item, self.pos, self.gap = gram[order], np.searchsorted(self.ids, item[order]), pos[order], gap[order]
        self.words = [words[i] for i in self.ids.tolist()]
        n = np.array([len(w) for w in self.words])
        self.needed = _needed(n, least, min_score)
        # what the pairs that are not left out must reach; the words of a document that an alignment can span
        self.sum, self.span = self.needed - 2 - 2 * ((self.needed - 2) // LEFT_OUT), 3 * n - self.needed
        self.table, self.single = Grams(self.gram), bool((self.gap == 0).any())

    def _begins(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """item (index) and word from which on the pairs within its span reach its sum, sorted by row, item and word."""
        ats, ks, weights = [], [], []
        for gap in (0, *GAPS) if self.single else GAPS:
            pair, whole = _pairs(row, h, gap)
            at = self.table.found(pair, whole)
            lo = np.searchsorted(self.gram, pair[at], "left")
            times = np.searchsorted(self.gram, pair[at], "right") - lo
            k = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            ats.append(np.repeat(at, times))
            ks.append(k)
            weights.append(1 + ((self.gap[k] < 2) & (gap < 2)))
        at, k, weight = np.concatenate(ats), np.concatenate(ks), np.concatenate(weights)
        for name in ("all", "position"):  # all pairs of a text and item, then the best of each position of the item
            both = row[at] * len(self.ids) + self.item[k]
            if name == "position":
                order = np.lexsort((-weight, self.pos[k], both))
                own = order[_first_of(both[order], self.pos[k][order])]
            else:
                own = slice(None)
            groups, group = np.unique(both, return_inverse=True)
            total = np.bincount(group[own], weights=weight[own], minlength=len(groups))
            keep = (total >= self.sum[groups % len(self.ids)])[group]
            at, k, weight = at[keep], k[keep], weight[keep]
        # one pair for each word of the text, then windows
        both = row[at] * len(self.ids) + self.item[k]
        order = np.lexsort((-weight, at, both))
        order = order[_first_of(both[order], at[order])]
        at, item, weight = at[order], self.item[k][order], weight[order]
        stretch = (np.cumsum(_first_of(both[order])) - 1) * (2 * len(h) + 2) + at
        upto = np.concatenate([[0], np.cumsum(weight)])
        reach = upto[np.searchsorted(stretch, stretch + np.minimum(self.span[item], len(h)), "right")] - upto[:-1]
        full = reach >= self.sum[item]
        return item[full], at[full]

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """row, item, score (share of the best possible), and the first and end word of the passage in the document."""
        for first, _, row, h in _words(texts):
            items, begins = self._begins(row, h)
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            known: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            parts: list[list[int]] = []
            for i, b in zip(items.tolist(), begins.tolist(), strict=True):
                r, span = int(row[b]), int(self.span[i])
                if parts and parts[-1][:2] == [r, i] and b - span <= parts[-1][3]:
                    parts[-1][3] = b + span
                else:
                    parts.append([r, i, b - span, b + span])
            for r, i, a, b in parts:
                zero = int(np.searchsorted(row, r, "left"))
                a, b = max(zero, a), min(int(np.searchsorted(row, r, "right")), b)
                passage = h[a:b]
                key = (i, passage.tobytes())
                if key not in known:
                    score, end = aligned(self.words[i], passage)
                    begin = end - aligned(self.words[i][::-1], passage[:end][::-1])[1] if score >= self.needed[i] else 0
                    known[key] = score, begin, end
                score, begin, end = known[key]
                if score >= self.needed[i] and score > best.get((r, i), (0,))[0]:
                    best[r, i] = (score, a + begin - zero, a + end - zero)
            for (r, i), (score, a, b) in best.items():
                yield first + r, int(self.ids[i]), score / (MATCH * len(self.words[i])), a, b


def _blocks(docs: DataFrame, benchmark: DataFrame, gram: int, min_score: float) -> Iterator[tuple]:
    """The arguments of Seeds for each block of items."""
    grams = cut(item_grams(benchmark, gram), "grams")
    total = grams.count()
    blocks = -(-total // BLOCK_GRAMS)
    for k in range(blocks):
        own = grams.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        # at most about BLOCK_GRAMS hashes and positions come to the driver
        hashes = own.select("gram").distinct().toArrow().column("gram").to_numpy().view(np.uint64)
        if not len(hashes):
            continue
        df = cut(document_frequency(docs, hashes), f"df{k}")
        known = own.join(df, "gram").select("gram", "item_id", "n", "pos", "gap", "df")
        place = known.groupBy("item_id", "pos").agg(F.sum("df").alias("df"), F.first("n").alias("n"))
        common = place.withColumn("nth", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("df"), "pos")))
        rows = known.drop("df", "n").join(common, ["item_id", "pos"]).select("gram", "item_id", "pos", "gap", "n", F.col("nth").cast("long")).toArrow()
        texts = own.where("words is not null").select("item_id", "words").toArrow()
        words = {i: np.array(w.values, np.int64).view(np.uint64) for i, w in zip(texts.column("item_id").to_pylist(), texts.column("words"), strict=True)}
        part = np.stack([c.to_numpy() for c in rows.columns], axis=1)
        part = part[part[:, 5] > (_needed(part[:, 4], gram, min_score) - 2) // LEFT_OUT]
        if len(part):
            yield part[:, 0].copy().view(np.uint64), part[:, 1].copy(), part[:, 2].copy(), part[:, 3].copy(), words, gram, min_score


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word: one row for each document and item that it holds a copy of.

    docs needs doc_id and text, benchmark item_id and text. Null or empty texts on either side and
    items without id match nothing; items of less than ``gram`` words match whole. Rows of docs that repeat give one row; a null doc_id is a value. Empty
    tables give an empty result. Other columns are not read.
    """
    out = None
    for seeds in _blocks(docs, benchmark, gram, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = Seeds(*shared.value)
            for batch in batches:
                rows = list(table.matches(batch.column("text")))
                if rows:
                    r, i, s, a, b = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                                     ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(match, "doc_id long, item_id long, score double, first_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, first_word long, end_word long")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "end_word")).alias("m")).select("doc_id", "item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, that hold no copy of an item."""
    for seeds in _blocks(docs, benchmark, gram, min_score):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = Seeds(*shared.value)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in table.matches(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
