"""Language identification by cross-parsing: the language whose sample text needs the fewest phrases for a text wins.

A suffix automaton of labelled text for each language knows all its substrings. A text is parsed greedily: a phrase is the
longest match with the sample, then the next begins. Phrases times the bits of a pointer into the sample, over the length
of the text, estimate the cross entropy. Texts are cut into pieces of PIECE bytes, all of them parsed side by side in
arrays, so that long texts take no more steps than short ones; a cut costs each language at most one phrase.

Bounds of the model: SAMPLE_DOCS labelled texts for each language (those of smallest hash), at most SAMPLE_CHARS characters
from the middle of each, SAMPLE_BYTES in all, or ALL_BYTES over the number of languages. The model is sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import text_blocks

SAMPLE_DOCS = 64
SAMPLE_CHARS = 1024
SAMPLE_BYTES = 16_384
ALL_BYTES = 524_288
PIECE = 512
UNDECIDED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def _squeezed(data: np.ndarray) -> np.ndarray:
    """Which bytes stay: letters, and the first of each run of other bytes."""
    letter = _LETTER[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    return keep


def suffix_automaton(codes: list[int], n_classes: int) -> np.ndarray:
    """Transitions (states x classes, -1: none) of the smallest automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    table = np.full((len(step), n_classes), -1, np.int32)
    for s, out in enumerate(step):
        for c, t in out.items():
            table[s, c] = t
    return table


class Model:
    """Automata of all languages in one table; a byte that no sample holds has class ``n_classes - 1``, without steps."""

    def __init__(self, samples: dict[str, bytes]) -> None:
        self.langs = sorted(samples)
        texts = {}
        for lang in self.langs:
            data = np.frombuffer(samples[lang], np.uint8)
            texts[lang] = np.where(_LETTER[data], data, 32)[_squeezed(data)]
        used = sorted(set(np.concatenate(list(texts.values())).tolist()) | {32}) if texts else [32]
        self.n_classes = len(used) + 1
        self.classes = np.full(256, len(used), np.uint8)
        self.classes[~_LETTER] = used.index(32)
        self.classes[used] = np.arange(len(used), dtype=np.uint8)
        tables, self.roots, self.bits, at = [], [], [], 0
        for lang in self.langs:
            t = suffix_automaton(self.classes[texts[lang]].tolist(), self.n_classes)
            tables.append(np.where(t >= 0, t + at, -1).astype(np.int32))
            self.roots.append(at)
            self.bits.append(math.log2(max(2, len(texts[lang]))))
            at += len(t)
        self.table = np.concatenate(tables).ravel() if tables else np.empty(0, np.int32)

    def phrases(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text for each language (texts x languages), and the parsed lengths."""
        keep = _squeezed(data)
        if len(offs) > 2:  # a text starts anew
            edge = offs[1:-1]
            keep[edge[edge < len(data)]] = True
        codes = self.classes[data][keep]
        ends = np.concatenate([[0], np.cumsum(keep)])[offs]
        size = np.diff(ends)
        pieces = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = ends[:-1][row] + nth * PIECE
        length = np.minimum(size[row] - nth * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        row, begin, length = row[order], begin[order], length[order]
        k, roots = self.n_classes, np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(row), 1)
        count = np.zeros(state.shape, np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -t, "left"))  # pieces longer than t
            c = codes[begin[:n] + t]
            now = self.table[state[:, :n] * k + c]
            stop = now < 0
            count[:, :n] += stop & (state[:, :n] != roots)  # a phrase ends before this byte
            now = np.where(stop, self.table[roots * k + c], now)
            count[:, :n] += now < 0  # a byte that the sample lacks is a phrase
            state[:, :n] = np.where(now < 0, roots, now)
        count += state != roots
        total = np.stack([np.bincount(row, c, len(size)) for c in count], 1) if len(self.langs) else np.zeros((len(size), 0))
        return total, size


def sample_texts(docs: DataFrame, learn: Column) -> dict[str, bytes]:
    """Lower-case sample text of each language, from rows (text, lang) where ``learn`` holds and lang is not null."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    first = rows.groupBy("lang", "h").agg(F.lit(1).alias("one"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ends = first.withColumn("k", nth).where(F.col("k") <= SAMPLE_DOCS).groupBy("lang").agg(F.max("h").alias("end"))
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - SAMPLE_CHARS) / 2)).cast("int"), F.lit(SAMPLE_CHARS))
    # SAMPLE_DOCS short pieces for each language
    picked = rows.join(F.broadcast(ends), "lang").where("h <= end").select("lang", "h", F.lower(middle).alias("t")).distinct().collect()
    langs = sorted({r["lang"] for r in picked})
    most = min(SAMPLE_BYTES, ALL_BYTES // max(1, len(langs)))
    out = {}
    for lang in langs:
        own = [r["t"].encode() for r in sorted((r for r in picked if r["lang"] == lang), key=lambda r: r["h"])]
        share = max(1, most // len(own))
        out[lang] = b" ".join(t[:share] for t in own) if sum(map(len, own)) > most else b" ".join(own)
    return {k: v for k, v in out.items() if any(_LETTER[list(v)])}


def languages(docs: DataFrame, learn: Column, carry: list[str]) -> DataFrame:
    """The carried columns of docs, lang_pred, score and bits (per byte, of the winner) for each row of docs.

    docs needs text, and lang where ``learn`` holds. Null texts and texts without a letter are "und" with score 0, as are
    all texts if nothing was learned. The score is the winner's share among the inverse entropies of all languages;
    ties go to the language that comes first by name. Repeated rows agree; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sample_texts(docs, learn))
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        names = np.array([*model.langs, UNDECIDED], object)
        for batch in batches:
            texts = batch.column("text_")
            for first, end, data, offs in text_blocks(pc.utf8_lower(texts), 4 << 20):
                n = end - first
                phrases, size = model.phrases(data, offs)
                ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
                some = np.diff(ascii_letters[offs]) > 0
                for r in np.flatnonzero(~some):
                    some[r] = any(map(str.isalpha, texts[first + int(r)].as_py() or ""))
                best, score, bits = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
                if model.langs:
                    entropy = np.maximum(phrases, 1) * np.array(model.bits) / np.maximum(size, 1)[:, None]
                    won = entropy.argmin(1)
                    low = entropy[np.arange(n), won]
                    best[some], bits[some] = won[some], low[some]
                    score[some] = ((1 / low) / (1 / entropy).sum(1))[some]
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, n) for c in batch.columns[:-1]], pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(bits)],
                    [*batch.schema.names[:-1], "lang_pred", "score", "bits"])

    packed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs["text"].alias("text_"))
    schema = ", ".join([*[f"c{i} {types[c]}" for i, c in enumerate(carry)], "lang_pred string, score double, bits double"])
    return packed.mapInArrow(predict, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
