"""Toxicity by a weighted lexicon: Aho-Corasick on folded text, exception phrases, length normalisation.

The lexicon is learned from the distinct labelled texts: words, and beginnings of words ("stem*", for languages that add
endings). A term needs a share of toxic texts far above the usual one, more than chance gives, and some different
surroundings. Surroundings are counted once however often they occur, and not where they share a neighbour with others that are
NEAR_TIMES as frequent, as those of edited copies do; so copies neither carry a term nor hide one that other texts carry,
and no bar rises with the number of texts. Two-word phrases with a term that clean documents use are exceptions.
The score is the weight of the terms found, the heaviest for each word, over the square root of the number of words, set
against labelled documents by isotonic regression over BINS levels.

Bounds of the model (a classifier on bounded features): at most MAX_CANDIDATES terms, the most frequent in toxic texts
of those with the share, are looked at, at most MAX_TERMS terms and MAX_PHRASES phrases are kept. Counts cover all distinct
labelled texts, the calibration all labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import cut

MAX_CANDIDATES = 100_000
MAX_TERMS = 5_000
MAX_PHRASES = 5_000
MIN_TOXIC = 5
STEM_LENGTHS = range(3, 9)
MIN_RATIO = 4.0
MIN_CONTEXTS = 4
MIN_EVIDENCE = 6.0
NEAR_TIMES = 8
BINS = 64
FEW_LABELS = 1_000_000

# ---- fixed values: lower-case look-alikes of Latin letters, and digits or signs written for letters
ALIKE = {"a": "аα", "b": "вβ", "c": "с", "d": "ԁ", "e": "еёε", "h": "н", "i": "іїιı", "j": "ј", "k": "кκ", "m": "м", "n": "η", "o": "оο",
         "p": "рρ", "q": "ԛ", "s": "ѕſ", "t": "тτ", "u": "υμ", "v": "ν", "w": "ԝω", "x": "хχ", "y": "у", "z": "ζ"}
WRITTEN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
# ------------------------------------------------------------------------------------------
LOOKALIKES = {ord(c): letter for letter, alike in ALIKE.items() for c in alike}
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS_IN_WORDS = re.compile(r"[0134578@$!]+(?=[^\W\d_])|(?<=[^\W\d_])[0134578]+(?!\w)")
_WIDE = re.compile("[！-～]")


def folded(text: str) -> str:
    """Lower case with look-alikes as Latin letters, one character for each."""
    if text.isascii():
        return text.lower()
    text = _WIDE.sub(lambda m: chr(ord(m[0]) - 0xFEE0), text)
    low = text.lower()
    if len(low) != len(text):  # a few letters become two in lower case
        low = "".join(c.lower()[0] for c in text)
    return low.translate(LOOKALIKES)


def unmasked(text: str) -> str:
    """Digits and signs inside or at the start of words as the letters they stand for; same length."""
    return _DIGITS_IN_WORDS.sub(lambda m: "".join(WRITTEN[c] for c in m[0]), text)


def terms_of(word: str) -> list[str]:
    """A folded word as a term, and its beginnings as stems."""
    return [word, *[word[:k] + "*" for k in STEM_LENGTHS if len(word) >= k]]


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: set[str]) -> None:
        import ahocorasick

        self.weights, self.exceptions = weights, exceptions
        self.automaton = ahocorasick.Automaton()
        for term in {t.rstrip("*") for t in weights}:
            self.automaton.add_word(term, term)
        self.automaton.make_automaton()

    def _whole(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Terms that begin with a word: a word up to its end, a stem up to anywhere."""
        for last, term in self.automaton.iter(text):
            a, b = last - len(term) + 1, last + 1
            if not (a and text[a - 1].isalpha()):
                if term in self.weights and not (b < len(text) and text[b].isalpha()):
                    yield a, b, term
                if term + "*" in self.weights:
                    yield a, b, term + "*"

    def hits(self, text: str) -> list[tuple[int, str, str, str, str]]:
        """start, the heaviest term, word, word before and word behind, for each word that a term begins."""
        if not self.weights or not text:
            return []
        plain = folded(text)
        found: dict[int, tuple[str, str]] = {}
        sources = [plain, unmasked(plain)] if _DIGITS_IN_WORDS.search(plain) else [plain]
        for source in sources:
            for a, _, t in self._whole(source):
                if a not in found or self.weights[t] > self.weights[found[a][0]]:
                    found[a] = (t, source)
        out = []
        for a, (t, source) in sorted(found.items()):
            word = _WORD.match(source, a)[0]
            before, behind = _WORD.findall(source[max(0, a - 60):a]), _WORD.findall(source[a + len(word):a + len(word) + 60])
            out.append((a, t, word, before[-1] if before else "", behind[0] if behind else ""))
        return out

    def value(self, text: str | None) -> tuple[float, int]:
        """Weight of the hits over the square root of the words, and the number of hits."""
        hits = [h for h in self.hits(text or "") if f"{h[3]} {h[2]}" not in self.exceptions and f"{h[2]} {h[4]}" not in self.exceptions]
        total = sum(self.weights[h[1]] for h in hits)
        return (total / math.sqrt(1 + len(text.split())), len(hits)) if hits else (0.0, 0)


def level(value: float) -> int:
    """One of BINS levels, eight to a doubling."""
    return 0 if value <= 0 else min(BINS - 1, max(1, 40 + math.floor(8 * math.log2(value))))


def _labelled(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """text, toxic (boolean) of the rows to learn from; several labels of a document: any toxic one counts."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    few = own.count() <= FEW_LABELS
    rows = docs.where(learn & F.col("text").isNotNull()).select("doc_id", "text")
    return cut(rows.join(F.broadcast(own) if few else own, "doc_id").select("text", "toxic"), "labelled")


def _distinct(rows: DataFrame) -> DataFrame:
    """The rows without those of equal text and label."""
    keyed = rows.withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit(1), "text"))
    return cut(keyed.dropDuplicates(["h1", "h2", "toxic"]).drop("h1", "h2"), "distinct")


def _counted(rows: DataFrame, name: str) -> DataFrame:
    """term and the number of texts that have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch.column("text").to_pylist():
                total.update({t for w in set(_WORD.findall(folded(text))) for t in terms_of(w)})
            yield pa.RecordBatch.from_pydict({"term": pa.array(total.keys(), pa.string()), name: pa.array(total.values(), pa.int64())})

    return rows.select("text").mapInArrow(count, f"term string, {name} long").groupBy("term").agg(F.sum(name).alias(name))


def learned(docs: DataFrame, labels: DataFrame, learn) -> tuple[dict[str, float], set[str], list[float]]:
    """Weights of terms, exception phrases and the probability of each level, from rows of docs where ``learn`` holds."""
    rows = _labelled(docs, labels, learn)
    texts = _distinct(rows)
    size = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = size.get(True, 0), size.get(False, 0)
    usual = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    odds = (F.col("t") + usual) / (F.col("c") + 1 - usual) * ((1 - usual) / usual)
    # log likelihood of the counts by their own share, against the usual one
    both = F.col("t") + F.col("c")
    evidence = F.col("t") * F.log(F.col("t") / both / usual) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / both / (1 - usual))).otherwise(0)

    often = _counted(texts.where("toxic"), "t").where(F.col("t") >= MIN_TOXIC)
    telling = (often.join(_counted(texts.where("not toxic"), "c"), "term", "left").withColumn("c", F.coalesce("c", F.lit(0)))
               .where(odds >= MIN_RATIO).orderBy(F.desc("t"), "term").limit(MAX_CANDIDATES))
    context = _contexts(texts, [r["term"] for r in telling.select("term").collect()])
    per_term = _apart(context).groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.sum((~F.col("toxic")).cast("long")).alias("c"))
    good = per_term.where((F.col("t") >= MIN_CONTEXTS) & (evidence >= MIN_EVIDENCE))
    rated = {r["term"]: math.log(r["w"]) for r in good.select("term", odds.alias("w"), "t").where(F.col("w") >= MIN_RATIO)
             .orderBy(F.desc("t"), "term").limit(MAX_TERMS).collect()}
    # a longer term stays only if it says more than the stems it begins with
    weights = {t: w for t, w in rated.items() if all(rated.get(s, 0.0) < w for s in terms_of(t.rstrip("*"))[1:] if len(s.rstrip("*")) < len(t.rstrip("*")))}
    phrases = context.select("toxic", "n", F.explode(F.array(
        F.when(F.col("before") != "", F.concat_ws(" ", "before", "word")), F.when(F.col("behind") != "", F.concat_ws(" ", "word", "behind")))).alias("phrase"))
    tame = phrases.where("phrase is not null").groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("c"))
    exceptions = {r["phrase"] for r in tame.where("c >= 3 and t * 4 <= c").orderBy(F.desc("c"), "phrase").limit(MAX_PHRASES).collect()}
    return weights, exceptions, _calibrated(rows, weights, exceptions, usual)


def _apart(context: DataFrame) -> DataFrame:
    """The contexts of terms without those that look like edits of one that is NEAR_TIMES as frequent."""
    for side in ("before", "behind"):
        most = context.groupBy("term", "toxic", side).agg(F.max("n").alias(f"most_{side}"))
        context = context.join(most, ["term", "toxic", side])
    return context.where(F.greatest("most_before", "most_behind") < NEAR_TIMES * F.col("n"))


def _contexts(rows: DataFrame, terms: list[str]) -> DataFrame:
    """term, before, word, behind, toxic, n: how often a candidate's word stands between two words, by label."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(shared.value)
        for batch in batches:
            count: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                w = _WORD.findall(folded(text))
                own = {x: [t for t in terms_of(x) if t in known] for x in set(w)}
                once = {(t, w[i - 1] if i else "", x, w[i + 1] if i + 1 < len(w) else "") for i, x in enumerate(w) for t in own[x]}
                count.update((*c, toxic) for c in once)
            if count:
                term, before, word, behind, toxic = zip(*count, strict=True)
                yield pa.RecordBatch.from_pydict({"term": list(term), "before": list(before), "word": list(word), "behind": list(behind),
                                                  "toxic": list(toxic), "n": pa.array(count.values(), pa.int64())})

    out = rows.mapInArrow(contexts, "term string, before string, word string, behind string, toxic boolean, n long")
    return cut(out.groupBy("term", "before", "word", "behind", "toxic").agg(F.sum("n").alias("n")), "contexts")


def _values(docs: DataFrame, carry: list[str], weights: dict[str, float], exceptions: set[str], chance: list[float]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((weights, exceptions, chance))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, apart, chances = shared.value
        matcher = Matcher(words, apart)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values = [matcher.value(t) for t in part.column("text_").to_pylist()]
                levels = [level(v) for v, _ in values]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([n for _, n in values], pa.int64()), pa.array(levels, pa.int32()),
                                                  pa.array([chances[x] if chances else 0.0 for x in levels], pa.float64())],
                                                 [*part.schema.names[:-1], "n_hits", "level", "score"])

    packed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs["text"].alias("text_"))
    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(carry)], "n_hits long, level int, score double"])
    return packed.mapInArrow(score, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})


def _calibrated(rows: DataFrame, weights: dict[str, float], exceptions: set[str], usual: float) -> list[float]:
    """The share of toxic documents at each level, never falling with it; BINS sums come to the driver.

    Level 0 (no hit) leans to the usual share, other levels to a half; a level that no document has lies between its
    neighbours.
    """
    seen = {r["level"]: (r["t"], r["n"]) for r in _values(rows, ["toxic"], weights, exceptions, []).groupBy("level")
            .agg(F.sum(F.col("toxic").cast("long")).alias("t"), F.count("*").alias("n")).collect()}
    stack: list[tuple[float, float, list[int]]] = []
    for k in sorted({0, *seen}):
        t, n = seen.get(k, (0, 0))
        stack.append((t + (usual if k == 0 else 0.5), n + 1.0, [k]))
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] > stack[-1][0] * stack[-2][1]:
            (t, n, high), (u, m, low) = stack.pop(), stack.pop()
            stack.append((t + u, n + m, low + high))
    known = [(k, t / n) for t, n, levels in stack for k in levels]
    return [float(x) for x in np.interp(range(BINS), *zip(*known, strict=True))]


def toxicity(docs: DataFrame, labels: DataFrame, learn, carry: list[str]) -> DataFrame:
    """The carried columns of docs, n_hits, level and score (0 to 1) for each row of docs (doc_id, text).

    ``learn`` is a condition on docs: only labels (doc_id, toxic) of such rows are used. Null and empty texts have no
    hit and the score of such texts. Without labels every text scores the same. Repeated rows score alike; columns
    outside ``carry`` are not read.
    """
    weights, exceptions, chance = learned(docs, labels, learn)
    return _values(docs, carry, weights, exceptions, chance)
