"""Token counts without token ids: pieces are counted once for each distinct pre-token and joined to the documents.

The join runs inside each task: a block of documents gives its pre-tokens, those that the task's table lacks are counted
by the tokenizer's model, and each document sums the table over its own pre-tokens. Nothing is shuffled. (Over the
cluster the same join would move a row for each document and distinct pre-token; see the README for figures.)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

LIMIT = 1024
#: entries of a task's table of pre-tokens; a full table is emptied, which costs time and changes no count
TABLE_ROWS = 400_000

# ---- fixed values: the letters, digits and white space below U+0250, and the contractions, of byte-level pre-tokenizers
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
DIGITS = "0-9²³¹¼-¾"
BLANKS = "\t-\r \u0085 "
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# -----------------------------------------------------------------------------------------------------------------------
LATIN = f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANKS}{LETTERS}{DIGITS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"


def byte_names() -> dict[int, str]:
    """The visible character that byte-level models use for each byte: its own, or the next free one from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def counter(model_json: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, for a byte-level tokenizer given as its JSON."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model_json)
    model, pre, names = tokenizer.model, tokenizer.pre_tokenizer, byte_names()
    latin, beyond = re.compile(LATIN), re.compile("[^\x00-ɏ]")
    special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    cut = re.compile("|".join(map(re.escape, special))) if special else None
    pieces: dict[str, int] = {}

    def pre_tokens(text: str) -> list[str]:
        if beyond.search(text):
            # classes of rarer characters differ between Unicode versions: the library's own decide
            return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]
        return latin.findall(text)

    def count(texts: list[str]) -> list[int]:
        own, extra = [], []
        for text in texts:
            parts = [text]
            if cut is not None and any(s in text for s in special):
                parts = cut.split(text)
            extra.append(len(parts) - 1)
            own.append([w for part in parts for w in pre_tokens(part)] if len(parts) > 1 else pre_tokens(text))
        if len(pieces) > TABLE_ROWS:
            pieces.clear()
        for w in set().union(*own).difference(pieces):
            pieces[w] = len(model.tokenize(w.encode().decode("latin-1").translate(names)))
        return [n + sum(map(pieces.__getitem__, words)) for n, words in zip(extra, own, strict=True)]

    return count


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text), by the byte-level tokenizer at ``path``.

    Null and empty texts have 0 tokens; strings of special tokens inside texts are one token each, as the library takes
    them; repeated rows come back as often as given; other columns are not read. The tokenizer's file is read on the
    driver and sent to the tasks (its size is that of the vocabulary).
    """
    with open(path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column("text").to_pylist()]
                tokens = count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                     pa.array([n > limit for n in tokens])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
