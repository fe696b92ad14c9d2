"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text are rejected.

Base figures of the whole text are taken beside it (words, symbols, repeated lines and word windows). All of it is a
function of one document, so there is no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: a text that keeps less than this share of the characters of its words is rejected
KEEP_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS_PER_WORD = 0.3
#: a line without any end of sentence is a fragment when it has fewer words
FRAGMENT_WORDS = 5

_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*(?:\s|$)")
_NAVIGATION = re.compile(
    r"^\W*(?:home|menu|search|log ?in|sign (?:in|up)|next|previous|prev|back to top|skip to (?:main )?content|read more|share|subscribe|contact(?: us)?|about(?: us)?)"
    r"(?:\W+(?:home|menu|search|log ?in|sign (?:in|up)|next|previous|prev|back|top|read more|share|subscribe|contact(?: us)?|about(?: us)?|faq|help|blog|news|products|pricing))*\W*$", re.I)
_BOILERPLATE = re.compile(
    r"all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|we use cookies|accept (?:all )?cookies|enable javascript|lorem ipsum|"
    r"click here to|sign up for our newsletter|©\s*\d{4}|copyright \(c\)|\{\s*$|^\s*\}", re.I)


class Verdict(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines: int
    n_punctuation: int
    n_navigation: int
    n_boilerplate: int
    clean_text: str


def line_fault(line: str, seen: bool) -> str | None:
    """The first rule that a line with words fails: punctuation, navigation, boilerplate; None where it passes."""
    if _NAVIGATION.match(line) or sum(map(line.count, "|»›·")) * 3 > len(line.split()):
        return "navigation"
    if seen or _BOILERPLATE.search(line):
        return "boilerplate"
    words = len(line.split())
    if sum(map(line.count, "#*$%&<>")) > SYMBOLS_PER_WORD * words or (words < FRAGMENT_WORDS and not _END.search(line)):
        return "punctuation"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that stand twice or more in the text, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total = end = 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def judged(text: str | None) -> Verdict:
    """All figures, the verdict and the cleaned text of one text; null counts as empty, which fails the base rules."""
    text = text or ""
    data = text.encode()
    words = data.split()
    chars = len(text.translate(_NO_SPACE))
    lines = text.split("\n")
    faults: Counter = Counter()
    seen: set[str] = set()
    good, n_lines, good_chars = [], 0, 0
    for line in lines:
        if not line.strip(" \t\x0b\x0c\r"):
            good.append(line)
            continue
        n_lines += 1
        fault = line_fault(line, line in seen)
        seen.add(line)
        if fault:
            faults[fault] += 1
        else:
            good.append(line)
            good_chars += len(line.translate(_NO_SPACE))
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    return Verdict(len(words), chars, sum(data.count(s) for s in SYMBOLS), n_lines - len(seen), repeated, failed,
                   not failed and good_chars >= KEEP_SHARE * chars, n_lines,
                   faults["punctuation"], faults["navigation"], faults["boilerplate"], "\n".join(good))


_NO_SPACE = dict.fromkeys(SPACE)
_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
           "n_lines long, n_punctuation long, n_navigation long, n_boilerplate long, clean_text string")


def clean_lines(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns of docs and the fields of Verdict, one row for each row of docs (needs text).

    Null and empty texts are rejected with zero figures; repeated rows are judged alike. A line without words is never
    a fault. Columns of docs outside ``carry`` are not read, so that their names cannot clash.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`c{i}` {types[c]}" for i, c in enumerate(carry)) + ", " + _SCHEMA
    packed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], docs["text"].alias("text_"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [judged(t) for t in part.column("text_").to_pylist()]
                fields = [pa.array([r[i] for r in rows], pa.string() if i == 11 else pa.bool_() if i in (5, 6) else pa.int64()) for i in range(12)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *fields], [*part.schema.names[:-1], *Verdict._fields])

    out = packed.mapInArrow(judge, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(carry)})
