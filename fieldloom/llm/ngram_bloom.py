"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words and pairs of neighbouring words of the training texts are counted exactly over the cluster. A count becomes a level
on a scale of half powers of two, and an n-gram of level q is entered in the filter once for each level from 1 to q: asking for
level after level until one is missing gives the count back, always at least as high as entered and rarely higher. The
filter is built in segments (the first bits of an n-gram's hash choose one), so that segments are filled in parallel; it
has a bounded size and goes to all workers, which score texts with no shuffle while all levels fit. Else the lowest levels are
left out, and what a text holds that the filter lacks is joined with the exact counts of these levels.

Words among the most frequent have their exact counts on all workers. A pair is asked for only if both of its words are there, and its count is never taken above theirs. The probability of a
word is that of a Dirichlet prior over the smoothed word counts: (c(h, w) + PRIOR * p(w)) / (c(h) + PRIOR).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .base import _mixed, cut, hashed_words, text_blocks

#: segments of the filter, as a power of two, and the least bits of one
SEGMENT_BITS, LEAST_BITS = 12, 1 << 10
#: size of the whole filter at most (64 MB); beyond its capacity the lowest levels are left out and joined
FILTER_BITS = 1 << 29
PROBES = 4
#: words whose exact counts go to all workers at most (16 MB); the other words are joined
KNOWN_WORDS = 1 << 20
#: weight of the word model, in words
PRIOR = 40.0
#: bits of segments that a task fills at once, a byte each
HELD_BITS = 64 << 20
#: n-grams that a task sums up before it hands them on
HELD_GRAMS = 1 << 22

#: least count of each level
LOW = np.unique(np.ceil(2.0 ** (np.arange(124) / 2))).astype(np.int64)
#: the count that a level stands for; level 0: none
VALUE = np.concatenate([[0.0], (LOW[:-1] + LOW[1:] - 1) / 2, [float(LOW[-1])]])

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BEGIN, _END = np.uint64(0x51ED270B7A1D6E35), np.uint64(0xC3A5C85C97CB3127)
_GOLD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ONE, _EVEN = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFE)


def text_tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (first row, tokens in each row, tokens, tokens before them) as 64-bit hashes.

    Tokens are the words between ASCII blanks, A-Z in lower case, and an end for each text; before the first stands a begin.
    """
    for first, end, data, offs in text_blocks(texts):
        _, _, row, h = hashed_words(_LOWER[data], offs, _INSIDE)
        size = np.bincount(row, minlength=end - first) + 1
        ends = np.cumsum(size)
        token = np.empty(ends[-1], np.uint64)
        token[np.arange(len(h)) + row] = h
        token[ends - 1] = _END
        before = np.concatenate([[_BEGIN], token[:-1]])
        before[ends[:-1]] = _BEGIN
        yield first, size, token & _EVEN, before & _EVEN


def pairs(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Hashes of pairs; odd, while those of words are even."""
    with np.errstate(over="ignore"):
        return _mixed(before * _GOLD + token) | _ONE


def level(count: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, count, "right")


def _merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    g, n = np.concatenate(grams), np.concatenate(counts)
    order = np.argsort(g)
    g, n = g[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[start], np.add.reduceat(n, start) if len(g) else n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n: the words and pairs of a task's texts, summed as far as HELD_GRAMS allows."""
    grams, counts, held = [], [], 0

    def out() -> pa.RecordBatch:
        g, n = _merged(grams, counts)
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], ["gram", "n"])

    for batch in batches:
        for _, _, token, before in text_tokens(batch.column("text")):
            for x in (token, pairs(before, token)):
                g, n = np.unique(x, return_counts=True)
                grams.append(g)
                counts.append(n.astype(np.int64))
                held += len(g)
            if held > HELD_GRAMS:
                grams, counts = [[x] for x in _merged(grams, counts)]
                held = len(grams[0])
                if held > HELD_GRAMS // 2:
                    yield out()
                    grams, counts, held = [], [], 0
    if held:
        yield out()


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind (0 word, 1 pair), level, number of n-grams, sum of their counts: one row for each kind and level of a task."""
    n_levels = len(LOW) + 1
    grams, tokens = np.zeros(2 * n_levels, np.int64), np.zeros(2 * n_levels, np.int64)
    for batch in batches:
        n = batch.column("n").to_numpy()
        at = (batch.column("gram").to_numpy() & 1) * n_levels + level(n)
        grams += np.bincount(at, minlength=2 * n_levels)
        np.add.at(tokens, at, n)
    some = np.flatnonzero(grams)
    yield pa.RecordBatch.from_arrays([pa.array((some // n_levels).astype(np.int32)), pa.array((some % n_levels).astype(np.int32)), pa.array(grams[some]), pa.array(tokens[some])],
                                     ["kind", "level", "grams", "tokens"])


def _places(grams: np.ndarray, at_level: int, probe: int, bits: int) -> np.ndarray:
    """The bits of n-grams at a level, for one probe, counted from the begin of their segments."""
    with np.errstate(over="ignore"):
        x = _mixed(grams + np.uint64(at_level) * _STEP)
        return ((x >> np.uint64(32)) * np.uint64(2 * probe + 1) + x) & np.uint64(bits - 1)


def _filled(bits: int, least: int):
    """segment, bits: the segments with the n-grams of a task from level ``least`` on."""
    slots = min(1 << SEGMENT_BITS, max(1, HELD_BITS // bits))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, slot, used = np.zeros((slots, bits), bool), np.full(1 << SEGMENT_BITS, -1), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            packed = [x.tobytes() for x in np.packbits(room[:len(used)], axis=1)]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(packed, pa.binary())], ["seg", "bits"])

        for batch in batches:
            g, q = batch.column("gram").to_numpy().view(np.uint64), level(batch.column("n").to_numpy())
            g, q = g[q >= least], q[q >= least]
            seg = (g >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)
            own = np.unique(seg)
            for part in (own[at:at + slots] for at in range(0, len(own), slots)):
                new = part[slot[part] < 0]
                if len(used) + len(new) > slots:
                    yield out()
                    slot[used], room[:], used, new = -1, False, used[:0], part
                slot[new] = np.arange(len(used), len(used) + len(new))
                used = np.append(used, new)
                inside = np.flatnonzero((seg >= part[0]) & (seg <= part[-1]))
                for j in range(1, int(q[inside].max()) + 1):
                    inside = inside[q[inside] >= j]
                    for i in range(PROBES):
                        room[slot[seg[inside]], _places(g[inside], j, i, bits).astype(np.int64)] = True
        if len(used):
            yield out()
    return fill


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of equal number laid over one another."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, b in zip(batch.column("seg").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            b = np.frombuffer(b, np.uint8)
            held[s] = held[s] | b if s in held else b
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["seg", "bits"])


class Filter:
    """Levels of n-grams, asked for probe by probe."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    def levels(self, grams: np.ndarray) -> np.ndarray:
        found = np.zeros(len(grams), np.int64)
        alive = np.arange(len(grams))
        base = (grams >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64) * self.bits
        for j in range(1, len(LOW) + 1):
            for i in range(PROBES):
                at = base[alive] + _places(grams[alive], j, i, self.bits).astype(np.int64)
                alive = alive[(self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
            if not len(alive):
                break
            found[alive] = j
        return found


@dataclass
class Model:
    """What scoring needs: the filter and the most frequent words on all workers, all n-grams with counts as a table."""

    shared: Broadcast
    counts: DataFrame
    known_from: int
    train_tokens: int
    distinct: int
    least_level: int
    bits: int

    @property
    def rest(self) -> DataFrame:
        """gram, n of the words that are not on all workers and the pairs of levels that the filter lacks."""
        pairs_below = int(LOW[self.least_level - 1]) if self.least_level <= len(LOW) else 1 << 62
        is_word = F.col("gram").bitwiseAND(F.lit(1)) == 0
        return self.counts.where(F.col("n") < F.when(is_word, self.known_from).otherwise(pairs_below))

    @property
    def total(self) -> float:
        return self.train_tokens + 0.1 * (self.distinct + 1)


def trained(docs: DataFrame, learn: Column, filter_bits: int = FILTER_BITS, known_words: int = KNOWN_WORDS) -> Model:
    """The model of the texts of docs for which ``learn`` holds. Null texts count as empty; repeated rows count each time."""
    spark = docs.sparkSession
    grams = docs.where(learn).select("text").mapInArrow(_counted, "gram long, n long").withColumn("seg", F.shiftrightunsigned("gram", 64 - SEGMENT_BITS))
    counts = cut(grams.repartition("seg").groupBy("seg", "gram").agg(F.sum("n").alias("n")).drop("seg"), "counts")
    shape = counts.mapInArrow(_levels, "kind int, level int, grams long, tokens long").groupBy("kind", "level").agg(F.sum("grams").alias("grams"), F.sum("tokens").alias("tokens")).collect()
    # the lowest level whose n-grams, with all above, leave half of the bits of the filter unset
    used, least = 0, len(LOW) + 1
    for q in range(len(LOW), 0, -1):
        used += sum(r["grams"] for r in shape if r["level"] == q) * q * PROBES
        if used > filter_bits * np.log(2):
            break
        least = q
    used = sum(r["grams"] * r["level"] for r in shape if r["level"] >= least) * PROBES
    bits = max(LEAST_BITS, filter_bits >> SEGMENT_BITS)
    while bits > LEAST_BITS and used < (bits >> 1 << SEGMENT_BITS) * np.log(2):
        bits >>= 1
    parts = counts.mapInArrow(_filled(bits, least), "seg int, bits binary").repartition("seg").mapInArrow(_united, "seg int, bits binary").toArrow()
    data = np.zeros((1 << SEGMENT_BITS, bits // 8), np.uint8)
    for s, b in zip(parts.column("seg").to_pylist(), parts.column("bits").to_pylist(), strict=True):
        data[s] = np.frombuffer(b, np.uint8)
    known_from, n = 1 << 62, 0
    for q in range(len(LOW), 0, -1):
        n += sum(r["grams"] for r in shape if r["level"] == q and r["kind"] == 0)
        if n > known_words:
            break
        known_from = int(LOW[q - 1])
    words = counts.where(F.col("gram").bitwiseAND(F.lit(1)) == 0)
    # at most known_words rows of two numbers, and the end
    end = int((np.array([_END]) & _EVEN).view(np.int64)[0])
    top = words.where((F.col("n") >= known_from) | (F.col("gram") == end)).toArrow()
    word, count = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(word)
    n_tokens, distinct = (sum(r[c] for r in shape if r["kind"] == 0) for c in ("tokens", "grams"))
    shared = spark.sparkContext.broadcast((data.ravel(), bits, word[order], count[order]))
    return Model(shared, counts, known_from, n_tokens, distinct, least, bits)


class _Words:
    """Counts of words as far as every worker knows them."""

    def __init__(self, filt: Filter, word: np.ndarray, count: np.ndarray, complete: bool):
        self.filt, self.word, self.count, self.complete = filt, word, count, complete
        there, c = self.exact(np.array([_END & _EVEN]))
        #: the end's value, which is also that of a begin
        self.texts = VALUE[level(c)][0] if there[0] else 0.0

    def exact(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word is one of the most frequent, and its count."""
        if not len(self.word):
            return np.zeros(len(u), bool), np.zeros(len(u), np.int64)
        at = np.searchsorted(self.word, u)
        at[at == len(self.word)] = 0
        there = self.word[at] == u
        return there, np.where(there, self.count[at], 0)

    def values(self, u: np.ndarray, there: np.ndarray, c: np.ndarray) -> np.ndarray:
        value = VALUE[level(c)]
        if not self.complete:
            value[~there] = VALUE[self.filt.levels(u[~there])]
        return value


def _by_row(row: np.ndarray, rows: int, *values: np.ndarray) -> list[pa.Array]:
    """Values as one list for each row."""
    order = np.argsort(row, kind="stable")
    ends = np.concatenate([[0], np.searchsorted(row[order], np.arange(rows), "right")]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in values]


def _log_probability(pair: np.ndarray, mine: np.ndarray, ahead: np.ndarray, total: float, prior: float) -> np.ndarray:
    alone = np.minimum((mine + 0.1) / total, 1.0)
    return np.log10((np.minimum(np.minimum(mine, ahead), pair) + prior * alone) / (ahead + prior))


def _scored(shared: Broadcast, total: float, complete: bool, full: bool, prior: float):
    """Rows with the sums of all tokens that workers know; ``full``: the filter holds all levels.

    ``rest, rest_n``: the words and (with 0) pairs to be joined; ``open_w, open_b, open_n``: tokens whose probability waits for that.
    """
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bits, word, count = shared.value
        filt = Filter(data, bits)
        known_words = _Words(filt, word, count, complete)
        for batch in batches:
            for first, size, token, before in text_tokens(batch.column("text_")):
                rows = len(size)
                row = np.repeat(np.arange(rows), size)
                u, of = np.unique(token, return_inverse=True)
                there, c = known_words.exact(u)
                sure = there | complete
                base = np.bincount(row, np.where(sure, np.log10((c + 0.1) / total), 0.0)[of], rows)
                known = np.bincount(row, (c > 0)[of], rows).astype(np.int64)
                rest = np.flatnonzero(~sure[of])
                both, tf = np.unique(row[rest] * len(u) + of[rest], return_counts=True)
                value = known_words.values(u, there, c)
                waits = (value == 0) & ~sure & (not full)

                def shifted(x: np.ndarray, begin: float) -> np.ndarray:
                    out = np.concatenate([[begin], x[:-1]])
                    out[np.cumsum(size)[:-1]] = begin
                    return out

                mine, mine_open = value[of], waits[of]
                ahead, ahead_open = shifted(mine, known_words.texts), shifted(mine_open, False).astype(bool)
                pair, pair_open = np.zeros(len(token)), np.zeros(len(token), bool)
                ask = np.flatnonzero(((mine > 0) | mine_open) & ((ahead > 0) | ahead_open))
                p, of_p = np.unique(pairs(before[ask], token[ask]), return_inverse=True)
                pair[ask] = VALUE[filt.levels(p)][of_p]
                pair_open[ask] = (pair[ask] == 0) & (not full)
                open_ = mine_open | ahead_open | pair_open
                lm = np.bincount(row, np.where(open_, 0.0, _log_probability(pair, mine, ahead, total, prior)), rows)
                # each open pair of words once for each text
                at = np.flatnonzero(open_)
                gram = pairs(before[at], token[at])
                order = np.lexsort((gram, row[at]))
                at, gram = at[order], gram[order]
                start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (row[at[1:]] != row[at[:-1]])])) if len(at) else at
                times = np.diff(np.append(start, len(at)))
                at, gram = at[start], gram[start]
                asked = pair_open[at]
                lists = _by_row(np.concatenate([both // max(1, len(u)), row[at][asked]]), rows,
                                np.concatenate([u[both % max(1, len(u))], gram[asked]]).view(np.int64), np.concatenate([tf.astype(np.int64), np.zeros(asked.sum(), np.int64)]))
                lists += _by_row(row[at], rows, token[at].view(np.int64), before[at].view(np.int64), times.astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[x.slice(first, rows) for x in batch.columns[:-1]], pa.array(size.astype(np.int64)), pa.array(known), pa.array(base), pa.array(lm), *lists],
                                                 [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score", "rest", "rest_n", "open_w", "open_b", "open_n"])
    return score


def _closed(shared: Broadcast, total: float, complete: bool, prior: float, kept: list[str]):
    """Rows with the tokens that waited: found_gram and found_n are the joined counts of a text's n-grams."""
    def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(name)
        return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, bits, word, count = shared.value
        filt = Filter(data, bits)
        known_words = _Words(filt, word, count, complete)
        for batch in batches:
            w, n_open = flat(batch, "open_w")
            b, times = flat(batch, "open_b")[0].astype(np.int64).view(np.uint64), flat(batch, "open_n")[0]
            w = w.astype(np.int64).view(np.uint64)
            gram, where = np.unique(flat(batch, "found_gram")[0].astype(np.int64).view(np.uint64), return_index=True)
            n = flat(batch, "found_n")[0].astype(np.int64)[where]

            def found(x: np.ndarray, value: np.ndarray) -> np.ndarray:
                if not len(gram):
                    return value
                at = np.searchsorted(gram, x)
                at[at == len(gram)] = 0
                return np.where((value == 0) & (gram[at] == x), VALUE[level(n[at])], value)

            words_of = lambda x: found(x, known_words.values(x, *known_words.exact(x)))
            mine, ahead = words_of(w), np.where(b == (_BEGIN & _EVEN), known_words.texts, words_of(b))
            p = pairs(b, w)
            more = np.bincount(np.repeat(np.arange(len(n_open)), n_open), times * _log_probability(found(p, VALUE[filt.levels(p)]), mine, ahead, total, prior), len(n_open))
            score = pa.array(batch.column("score").to_numpy() + more)
            yield pa.RecordBatch.from_arrays([score if c == "score" else batch.column(c) for c in kept], kept)
    return close


def scored(docs: DataFrame, model: Model, carry: list[str], prior: float = PRIOR) -> DataFrame:
    """The carried columns of docs, n_tokens, n_known, base_score and score for each row of docs.

    base_score is the sum of log10((c + 0.1) / (N + 0.1 * (V + 1))) over the tokens with exact counts c, of which n_known are
    above 0; score is the sum of log10 probabilities of the pair model. Null texts are empty: one token, the end. Repeated
    rows agree; other columns are not read; an empty table gives an empty result. Words are compared by 63 bits of a hash.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    complete, full = model.known_from <= 1, model.least_level <= 1
    packed = docs.select(F.monotonically_increasing_id().alias("rid"), *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs["text"].alias("text_"))
    schema = ", ".join(["rid long", *[f"c{i} {types[c]}" for i, c in enumerate(carry)], "n_tokens long, n_known long, base_score double, score double, rest array<long>, rest_n array<long>, open_w array<long>, open_b array<long>, open_n array<long>"])
    rows = packed.mapInArrow(_scored(model.shared, model.total, complete, full, prior), schema)
    names = {f"c{i}": c for i, c in enumerate(carry)}
    lists = ["rest", "rest_n", "open_w", "open_b", "open_n"]
    if complete and full:
        return rows.drop("rid", *lists).withColumnsRenamed(names)
    rows = cut(rows, "scored")
    # words that are not among the most frequent and n-grams that the filter lacks: a row for each document and n-gram
    rare = rows.select("rid", F.explode(F.arrays_zip("rest", "rest_n")).alias("z")).select("rid", F.col("z.rest").alias("gram"), F.col("z.rest_n").alias("tf"))
    c = F.coalesce("n", F.lit(0))
    there = F.struct("gram", "n")
    found = [] if full else [F.collect_list(F.when(c > 0, there)).alias("found")]
    more = rare.join(model.rest, "gram", "left").groupBy("rid").agg(
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("more_known"), F.sum(F.col("tf") * F.log10((c + 0.1) / model.total)).alias("more_base"), *found)
    out = rows.drop("rest", "rest_n").join(more, "rid", "left")
    out = out.withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0))).withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0)))
    if not full:
        kept = [*names, "n_tokens", "n_known", "base_score", "score"]
        wide = out.select(*kept, "open_w", "open_b", "open_n", F.col("found.gram").alias("found_gram"), F.col("found.n").alias("found_n"))
        out = wide.mapInArrow(_closed(model.shared, model.total, complete, prior, kept), ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(carry)], "n_tokens long, n_known long, base_score double, score double"]))
    return out.drop("rid", "more_known", "more_base", *lists).withColumnsRenamed(names)
