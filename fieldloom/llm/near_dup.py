"""Near-duplicates by MinHash bands, verified first by odd sketches and then on the full shingle sets.

One pass over the texts gives, for each distinct shingle set, MinHash bands and an odd sketch: the MinHash samples folded
into a bitmap in which every sample flips one bit. The count of ones in the XOR of two sketches estimates their
similarity most exactly where it is high, so that few wrong candidates reach the exact check.

Buckets of equal band values are worked off in two phases. In the first, bands come in waves; every member of a bucket that is
not yet in the component most of the bucket is in meets one member of that component, the centre, and confirmed links
join components before the next wave. So a large group of copies costs a row for each member in the first band and little
in the others. In the second phase only buckets that still hold more than one component go on, with more
centres each round until every member is one: false neighbours are compared with all, and no bucket has a cap. There a pair
has to pass a finer odd sketch, that of the whole sets: its XOR never has more ones than the sets have different
shingles. A bucket whose pairs across components are few for its size is finished at once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import _mixed, cut, hashed_words, text_blocks

ROWS, BANDS = 4, 28
#: MinHash samples in a sketch: those of the bands and twice as many more
SAMPLES = 3 * ROWS * BANDS
SKETCH_BITS = 2048
#: a pair of similarity 0.8 is below this estimate once in some 10^5 cases
SKETCH_FLOOR = 0.70
WORDS = SKETCH_BITS // 64
#: bits of the odd sketch of a whole set, in 64-bit words
SET_WORDS = 32
#: first bands of the waves of the first phase
WAVES = (0, 4)
#: centres of a bucket in the first round of the second phase, and the factor from round to round
FIRST_CENTRES = 64
#: a bucket with at most so many pairs across components for each member is finished at once
EASY_PAIRS = 32
#: up to so many ids go to all tasks (8 MB); more are joined by shuffle
FEW_IDS = 1_000_000

_SPACE = [0x20, *range(0x09, 0x0E)]
_INSIDE = np.ones(256, bool)
_INSIDE[_SPACE] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (first row, sorted distinct shingle hashes of all rows behind one another, ends of the rows).

    A-Z in lower case, words between ASCII white space; a text of fewer than ``width`` words has one shingle, its whole
    word sequence; without words it has none.
    """
    for first, end, data, offs in text_blocks(texts, 1 << 19):
        _, _, row, h = hashed_words(_LOWER[data], offs, _INSIDE)
        n_rows = end - first
        words = np.bincount(row, minlength=n_rows)
        begin = np.concatenate([[0], np.cumsum(words)])
        with np.errstate(over="ignore"):
            mixed = h.copy()
            for k in range(1, width):
                mixed[:len(h) - k] = _mixed(mixed[:len(h) - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
            left = begin[row + 1] - np.arange(len(h))
            keep = left >= width
            short = np.flatnonzero((words > 0) & (words < width))
            if len(short):
                keep[begin[short]] = True
                for r in short:  # fewer than ``width`` words each
                    s = np.uint64(words[r])
                    for x in h[begin[r]:begin[r + 1]]:
                        s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + x)
                    mixed[begin[r]] = s
        row, mixed = row[keep], mixed[keep]
        order = np.lexsort((mixed, row))
        row, mixed = row[order], mixed[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (mixed[1:] != mixed[:-1])
        row, mixed = row[new], mixed[new]
        yield first, mixed, np.searchsorted(row, np.arange(n_rows), "right")


def _signatures(width: int):
    rng = np.random.default_rng(20240611)
    a = rng.integers(0, 1 << 63, SAMPLES, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, SAMPLES, np.uint64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, hashes, ends in shingle_sets(texts, width):
                n = len(ends)
                sizes = np.diff(ends, prepend=0)
                some = np.flatnonzero(sizes)
                bands = np.zeros((n, BANDS), np.int64)
                sketch = np.zeros((n, SKETCH_BITS // 64), np.int64)
                prints = np.zeros((n, 2), np.int64)
                if len(some):
                    start = (ends - sizes)[some]
                    with np.errstate(over="ignore"):
                        low = np.stack([np.minimum.reduceat((hashes * x + y) >> np.uint64(24), start) for x, y in zip(a, b, strict=True)], 1)
                        key = np.zeros((len(some), BANDS), np.uint64)
                        for r in range(ROWS):
                            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[:, r:ROWS * BANDS:ROWS])
                        bands[some] = _mixed(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                        at = (_mixed(low + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(SKETCH_BITS)).astype(np.int64)
                        bits = np.zeros((len(some), SKETCH_BITS), np.uint8)
                        np.add.at(bits, (np.arange(len(some))[:, None], at), 1)
                        sketch[some] = np.packbits(bits & 1, axis=1).view(np.int64)
                        prints[some] = _prints(hashes, start)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(sizes, pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]),
                     pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64())),
                     pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel()), SKETCH_BITS // 64).cast(pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "p", "q", "bands", "sketch"])
    return signed


def _prints(hashes: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two sums over each set: equal for equal sets, whatever the order of words."""
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(hashes, start), np.add.reduceat(_mixed(hashes), start)], 1).view(np.int64)


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, ends in shingle_sets(batch.column("text"), width):
                start = np.concatenate([[0], ends[:-1]])
                some = ends > start
                if not some.any():
                    continue
                both = _prints(hashes, start[some])
                lists = pa.ListArray.from_arrays(pa.array(np.append(start[some], ends[-1]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists], ["p", "q", "shingles"])
    return sets


def _parities(width: int):
    """p, q and the odd sketch of the whole set of each text."""
    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, ends in shingle_sets(batch.column("text"), width):
                start = np.concatenate([[0], ends[:-1]])
                some = np.flatnonzero(ends > start)
                if not len(some):
                    continue
                row = np.searchsorted(ends[some], np.arange(len(hashes)), "right")
                bit = (_mixed(hashes ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(20)).astype(np.int64) % (64 * SET_WORDS)
                ones = np.bincount(row * (64 * SET_WORDS) + bit, minlength=len(some) * 64 * SET_WORDS).reshape(len(some), -1)
                words = np.packbits((ones & 1).astype(np.uint8), axis=1).view(np.int64)
                both = _prints(hashes, start[some])
                lists = pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), SET_WORDS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists], ["p", "q", "parity"])
    return parities


def _ones(a: str, b: str, name: str, words: int) -> Column:
    """Ones in the XOR of two rows' words."""
    return functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{name}{i}").bitwiseXOR(F.col(f"{b}{name}{i}"))) for i in range(words)])


def _near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and the odd sketches of whole sets (words z0 and so on behind the prefixes) allow the similarity.

    Sets of n and m shingles with the similarity differ in at most d = (n + m) * (100 - percent) / (100 + percent); the XOR has no
    more ones than that. Where d is large against the sketch, the expected ones and five deviations are a sharper bar.
    """
    d, bits = (F.col(a + "n_shingles") + F.col(b + "n_shingles")) * ((100 - percent) / (100 + percent)), 64 * SET_WORDS
    expected = (1 - F.exp(-2 * d / bits)) * (bits / 2)
    n, m = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_ones(a, b, "z", SET_WORDS) <= F.least(d + 1e-6, expected + 5 * bits ** 0.5 / 2))


def _close(a: str, b: str, percent: int) -> Column:
    """Whether sizes and odd sketches of two rows (n_shingles, k0 to k7 behind the prefixes) allow the similarity.

    With k samples on each side the XOR of two sketches of n bits has n / 2 * (1 - exp(-4 * k * (1 - s) / n)) ones at
    similarity s; pairs with more ones than SKETCH_FLOOR would give are out.
    """
    most = int(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - SKETCH_FLOOR * percent / 80) / SKETCH_BITS)))
    n, m = F.col(a + "n_shingles"), F.col(b + "n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (_ones(a, b, "k", WORDS) <= most)


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for all nodes of edges (a, b), by smallest neighbours and jumps.

    Every node takes the smallest label around it, then the label of its label; depth halves each round. Rounds end when
    nothing changes; each is cut, so that a lost executor costs one round.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "both")
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("node"), "c"), "label")
    turn = 0
    while True:
        around = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("c").alias("low"))
        nearer = label.join(around, label["node"] == around["a"]).select("node", F.col("c").alias("old"), F.least("c", "low").alias("c"))
        up = label.select(F.col("node").alias("top"), F.col("c").alias("higher"))
        after = cut(nearer.join(up, nearer["c"] == up["top"], "left").select("node", F.least("c", "higher").alias("c"), "old"), f"label{turn}")
        label = after.select("node", "c")
        turn += 1
        if not after.where("c != old").take(1):
            return label.select("node", F.col("c").alias("component"))


def _joined(top: DataFrame | None, links: DataFrame, turn: int) -> DataFrame:
    """The components after some more links: only components that the links touch are joined anew."""
    if top is None:
        return components(links)
    of = lambda k: top.select(F.col("node").alias(k), F.col("component").alias("c" + k))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = components(cut(between.where("a != b").distinct(), f"between{turn}")).select(F.col("node").alias("old"), F.col("component").alias("new"))
    alone = over.select(F.col("old").alias("node"), F.col("old").alias("component")).join(top, "node", "left_anti")
    every = top.unionByName(alone)
    return cut(every.join(over, every["component"] == over["old"], "left").select("node", F.coalesce("new", "component").alias("component")), f"top{turn}")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    sa = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(sb, "b").join(sa, "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    measured = both.select("a", "b", inter.alias("i"), (F.size("sa") + F.size("sb")).alias("n"))
    return measured.where(F.col("i") * 100 >= (F.col("n") - F.col("i")) * percent).select("a", "b")


def _node(salt: int) -> Column:
    """The id of a set with prints p and q."""
    return F.xxhash64("p", "q") if not salt else F.xxhash64("p", "q", F.lit(salt))


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """text of the carriers of nodes: all that later rounds read of the documents."""
    ids = nodes.select("carrier").distinct()
    few = ids.count() <= FEW_IDS
    return docs.where("text is not null").join(F.broadcast(ids) if few else ids, docs["doc_id"] == ids["carrier"], "left_semi").select("text")


def _sets_of(texts: DataFrame, nodes: DataFrame, width: int, salt: int) -> DataFrame:
    """node, shingles for the given nodes."""
    # the ids of carriers may repeat: sets of other documents go, and one copy of each stays
    sets = texts.mapInArrow(_sets(width), "p long, q long, shingles array<long>").withColumn("node", _node(salt))
    few = nodes.count() <= FEW_IDS
    wanted = nodes.select("node")
    return sets.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) for each row of docs (doc_id, text).

    Linked are documents whose sets of ``width``-word shingles have 100 * intersection >= percent * union. Null, empty and
    blank texts have no shingles, are linked with nothing and have their own id as component, as have rows without
    doc_id (null). Repeated rows come back as often as given. Empty table: empty result. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, p long, q long, bands array<long>, sketch array<long>"
    prints = cut(docs.mapInArrow(_signatures(width), schema), "signatures")
    # a node is a distinct set; its carrier is the smallest id that has it
    by_print = cut(prints.where("n_shingles > 0 and doc_id is not null").groupBy("p", "q").agg(
        F.min("doc_id").alias("carrier"), F.min("n_shingles").alias("n_shingles"), F.min("bands").alias("bands"), F.min("sketch").alias("sketch")), "nodes")
    salt = 0
    while by_print.groupBy(_node(salt).alias("node")).count().where("count > 1").take(1):
        salt += 1
    signed, nodes = prints.withColumn("node", _node(salt)), by_print.withColumn("node", _node(salt))
    word = lambda c, i, name: F.coalesce(F.col(c)[i], F.lit(0)).alias(f"{name}{i}")
    light = nodes.select("node", "n_shingles", *[word("sketch", i, "k") for i in range(WORDS)])
    side = lambda df, at, prefix: df.select(*[F.col(c).alias(at if c == "node" else c if c == "key" else prefix + c) for c in df.columns])
    bands = nodes.select("node", F.posexplode("bands").alias("pos", "band")).select("node", "pos", F.xxhash64("pos", "band").alias("key"))
    crowded = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    member = cut(bands.join(crowded, "key").withColumn("c", F.col("node")), "members")
    texts = cut(_texts_of(docs, nodes.join(member.select("node").distinct(), "node")), "texts")
    tried: DataFrame | None = None
    top: DataFrame | None = None

    def worked(close: DataFrame, turn: int) -> None:
        """Confirm pairs (a, b) and join the components of those that are links."""
        nonlocal tried, top, member
        if tried is not None:
            close = close.join(tried, ["a", "b"], "left_anti")
        close = cut(close, f"close{turn}")
        tried = close if tried is None else tried.unionByName(close)
        if close.take(1):
            wanted = cut(close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct(), f"wanted{turn}")
            good = cut(_confirmed(close, cut(_sets_of(texts, wanted, width, salt), f"sets{turn}"), percent), f"links{turn}")
            top = _joined(top, good, turn)
            member = member.drop("c").join(top.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))

    for turn, first in enumerate(WAVES):
        last = WAVES[turn + 1] if turn + 1 < len(WAVES) else BANDS
        own = member.where(F.col("pos").between(first, last - 1))
        parts = own.groupBy("key", "c").agg(F.count("*").alias("s"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("m"))
        centres = parts.groupBy("key").agg(F.max(F.struct("s", "c", "m.node")).alias("most"), F.count("*").alias("k")).where("k > 1")
        met = own.join(centres.select("key", F.col("most.c").alias("major"), F.col("most.node").alias("centre")), "key").where("c != major")
        pairs = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        worked(pairs.join(side(light, "b", "b_"), "b").join(side(light, "a", "a_"), "a").where(_close("a_", "b_", percent)).select("a", "b"), turn)
        member = cut(member, f"members{turn}")
    turn = 0
    while True:
        turn += 1
        # a growing share of the members, the same in all buckets, are centres, until few pairs lie across components:
        # then all of them are met, as one side of each is outside the largest component
        parts = member.groupBy("key", "c").agg(F.count("*").alias("s")).groupBy("key").agg(
            F.sum(F.col("s") * F.col("s")).alias("inner"), F.count("*").alias("k"), F.max(F.struct("s", "c")).alias("most"))
        member = cut(member.select("key", "node", "pos", "n", "c").join(parts.where("k > 1").select("key", "inner", F.col("most.c").alias("major")), "key"), f"open{turn}")
        if not member.take(1):
            break
        if turn == 1:
            left = cut(member.select("node").distinct(), "left")
            few = left.count() <= FEW_IDS
            parity = texts.mapInArrow(_parities(width), "p long, q long, parity array<long>").withColumn("node", _node(salt)).join(F.broadcast(left) if few else left, "node", "left_semi")
            parity = parity.groupBy("node").agg(F.first("parity").alias("parity"))
            fine = cut(nodes.select("node", "n_shingles").join(parity.select("node", *[word("parity", i, "z") for i in range(SET_WORDS)]), "node"), "fine")
        share = F.lit(float(FIRST_CENTRES) ** turn) / F.col("n")
        across = (F.col("n") * F.col("n") - F.col("inner")) / 2
        done = (share >= 1) | (across <= EASY_PAIRS * F.col("n"))
        drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30) <= share
        open_ = member.join(fine, "node").drop("pos")
        centres = open_.where((done & (F.col("c") != F.col("major"))) | (~done & drawn)).drop("n", "inner", "major")
        left, right = side(open_.drop("n", "inner", "major"), "a", "a_"), side(centres, "b", "b_")
        met = left.join(right, (left["key"] == right["key"]) & (F.col("a_c") != F.col("b_c")) & _near("a_", "b_", percent))
        worked(met.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), len(WAVES) + turn)
        member = cut(member.where(~done), f"left{turn}")
    ids = nodes.select("node", "carrier")
    if top is not None:
        whole = ids.join(top, "node").groupBy("component").agg(F.min("carrier").alias("first"))
        ids = ids.join(top, "node", "left").join(whole, "component", "left").select("node", F.coalesce("first", "carrier").alias("first"))
    else:
        ids = ids.withColumnRenamed("carrier", "first")
    own = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return own.join(ids, "node", "left").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without all but the first (smallest doc_id) of each group of near-duplicates.

    Rows of equal doc_id and text are one document, of which one row stays. Rows without doc_id stay.
    """
    found = cut(near_duplicates(docs, width, percent), "groups")

    def without(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = ids.count() <= FEW_IDS
        return df.join(F.broadcast(ids) if few else ids, "doc_id", how)

    later = cut(found.where("doc_id != component_id").select("doc_id").distinct(), "later")
    kept = without(docs, later, "left_anti")
    twice = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.take(1):
        kept = without(kept, twice, "left_anti").unionByName(without(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept
