"""Label search over lines, keyword search, chunks for the fallback queue.

A label of whole words can only match a line that holds the label's words, so lines and labels meet in an equi-join
on one word of the label (its longest); the pattern then checks the few pairs that are left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from . import discovery as D
from . import resolve as R

# ---- fixed values -------------------------------------------------------------------------
SEARCH_CONFIDENCE = {"Exact": 0.95, "Normalized": 0.92, "Table": 0.90, "Context": 0.85}
KEYWORD_CONFIDENCE = {"inline": 0.92, "tail": 0.90, "next": 0.85}
ANSWER_CONFIDENCE = 0.85
CHUNK_BEFORE, CHUNK_AFTER, CHUNK_LINES, CHUNK_CHARS = 15, 14, 100, 8000
GAP = "... [gap] ..."
# -------------------------------------------------------------------------------------------

MAX_LABELS = 50_000


def anchor_word(label: str) -> str:
    words = re.findall(r"[^\W_]+", label.lower())
    return max(words, key=len) if words else ""


def label_dim(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """``(label, label_rank, anchor)``; the list is checked, so the join may broadcast it."""
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels; pass more than {MAX_LABELS} as a table")
    rows = [(a, i, anchor_word(a)) for i, a in enumerate(labels)]
    return spark.createDataFrame(rows, "label string, label_rank int, anchor string")


def label_dim_of(labels: DataFrame) -> DataFrame:
    """The same from a table with ``label`` (other columns are kept)."""
    words = F.regexp_extract_all(F.lower("label"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))
    return labels.withColumn("anchor", F.coalesce(longest["w"], F.lit("")))


def with_following(docs: DataFrame, keys: Sequence[str] = ("doc_id",), ahead: int = 4) -> DataFrame:
    """Lines with the ``ahead`` lines after them (blank ones too), from the document's own array; 0: without ``following``."""
    if ahead == 0:
        return D.plain_lines(docs, keys)

    def rows(ls: Column) -> Column:
        return F.filter(
            F.transform(ls, lambda x, i: F.struct(
                (i + 1).alias("line_no"), x.alias("text"), F.slice(ls, i + 2, ahead).alias("following"))),
            lambda r: r["text"] != "")

    return (
        docs.select(*keys, F.explode_outer(T.let(T.stripped_lines(F.col("text")), rows)).alias("r"))
        .filter(F.col("r").isNotNull()).select(*keys, "r.*")
    )


def anchor_join(lines: DataFrame, dim: DataFrame, on: str = "text", label: str = "label") -> DataFrame:
    """Lines next to the labels whose anchor word they hold; callers check the whole label by a pattern.

    A pattern per row is costly, so pairs of plain ASCII must first hold the lower-cased label, which is exact for them;
    others go straight to the pattern, whose case rules differ from ``lower`` for some letters.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(on), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    labels = dim.withColumn("_label", F.when(T.is_ascii(F.col(label)), F.lower(label)))
    held = lines.withColumn("_held", F.when(T.is_ascii(F.col(on)), F.lower(on)))
    pairs = held.withColumn("anchor", F.explode(words)).join(F.broadcast(labels), "anchor")
    return pairs.filter(F.coalesce(F.contains("_held", "_label"), F.lit(True))).drop("anchor", "_held", "_label")


def whole_word(label: Column, case_sensitive: bool = False) -> Column:
    flag = "(?U)" if case_sensitive else "(?iU)"
    return F.concat(F.lit(flag + r"\b"), T.quote_regex(label), F.lit(r"\b"))


def whole_at(text: Column, label: Column, case_sensitive: bool = False, bare: bool = False) -> Column:
    """Where the label first stands in the text as whole words, 0 where it stands nowhere, null where a pattern must say.

    Pairs of plain ASCII need no pattern unless their first occurrence lies inside a word. An edge is a word boundary or,
    with ``bare``, the absence of a word character.
    """
    same = (lambda c: c) if case_sensitive else F.lower
    word = lambda c: c.rlike("^[A-Za-z0-9_]")

    def judged(at: Column) -> Column:
        before = F.when(at > 1, F.substr(text, at - 1, F.lit(1))).otherwise("")
        after = F.substr(text, at + F.length(label), F.lit(1))
        whole = (~word(before) & ~word(after)) if bare else (word(before) != word(label)) & (word(after) != word(F.right(label, F.lit(1))))
        return F.when(at == 0, at).when(whole, at)

    return F.when(T.is_ascii(text) & T.is_ascii(label), T.let(F.call_function("locate", same(label), same(text)), judged))


def holds_whole(text: Column, label: Column) -> Column:
    return T.let(whole_at(text, label), lambda at: F.when(at.isNotNull(), at > 0).otherwise(F.regexp_like(text, whole_word(label))))


def only(rows: DataFrame, name: str, value: Column, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows with a value that passes. The value is made once: a filter on a column would be pushed below and repeat it."""
    return rows.withColumn(name, F.explode_outer(F.filter(F.array(value), keep))).filter(F.col(name).isNotNull())


def _found(rows: DataFrame, value: Column, strategy: str, line: Column, pos: Column) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("text", "following", "line_no", "cell", "next_cell", "pos", "value")]
    return rows.select(*keep, line.cast("int").alias("source_line"), value.alias("value"),
                       F.lit(SEARCH_CONFIDENCE[strategy]).alias("confidence"), F.lit(strategy).alias("strategy"),
                       pos.cast("int").alias("pos"))


def search_inline(lines: DataFrame, dim: DataFrame, case_sensitive: bool) -> DataFrame:
    """Text after the label on its line."""
    text, label = F.col("text"), F.col("label")
    pattern = F.concat(whole_word(label, case_sensitive), F.lit(r"\s*[:\-–—=]?\s*(.+)"))
    tail = lambda at: F.regexp_replace(F.substr(text, at + F.length(label)), r"^\s*[:\-–—=]?\s*", "")
    value = T.let(whole_at(text, label, case_sensitive), lambda at: T.strip(
        F.when(at > 0, tail(at)).when(at.isNull(), T.extract(text, pattern, 1))))
    rows = only(anchor_join(lines, dim), "value", value, lambda v: (F.length(v) >= 2) & (F.length(v) < 200))
    return _found(rows, F.col("value"), "Exact" if case_sensitive else "Normalized", F.col("line_no"), F.lit(0))


def search_table(lines: DataFrame, dim: DataFrame) -> DataFrame:
    """The cell after the one that holds the label."""
    parts = F.filter(F.transform(F.split("text", r"\||" + T.BLANK + "{2,}", -1), T.strip), lambda p: p != "")
    keys = [c for c in lines.columns if c not in ("text", "following")]
    cells = (
        lines.filter(F.col("text").contains("|") | F.col("text").contains("  "))
        .select(*keys, F.posexplode(parts).alias("pos", "cell"), parts.alias("parts"))
        .withColumn("next_cell", F.get("parts", F.col("pos") + 1)).drop("parts").filter(F.col("next_cell").isNotNull())
    )
    rows = anchor_join(cells, dim, "cell").filter(holds_whole(F.col("cell"), F.col("label")))
    return _found(rows, F.col("next_cell"), "Table", F.col("line_no"), F.col("pos"))


def search_following(lines: DataFrame, dim: DataFrame) -> DataFrame:
    """The lines under the label: the next one, and up to three more until a short, colon or rule line."""
    rows = anchor_join(lines, dim).filter(holds_whole(F.col("text"), F.col("label")))
    first = F.get("following", F.lit(0))
    rows = rows.filter((F.length(first) >= 2) & (F.length(first) < 200) & ~first.contains(":"))
    good = lambda x: (F.length(x) >= 2) & ~x.contains(":") & ~x.rlike("---|===|___")
    rest = F.slice("following", 2, 3)
    stop = F.array_position(F.transform(rest, lambda x: ~good(x)), F.lit(True))
    kept = F.when(stop == 0, rest).otherwise(F.slice(rest, 1, F.greatest(stop.cast("int") - 1, F.lit(0))))
    return _found(rows, F.array_join(F.concat(F.array(first), kept), "\n"), "Context", F.col("line_no") + 1, F.lit(0))


def priority_pick(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """Highest confidence, then strategy priority, then first in the document."""
    prio = F.create_map(*[F.lit(x) for kv in R.STRATEGY_RANK.items() for x in kv])[F.col("strategy")]
    rest = [c for c in found.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct("confidence", prio.alias("p"), (-F.col("source_line")).alias("l"), (-F.col("pos")).alias("i")))
    return found.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def keyword_search(docs: DataFrame, keywords: dict[str, Sequence[str]], key: str = "doc_id") -> DataFrame:
    """First hit per document and field: keyword by keyword, inline over the text, else line by line, else the next line."""
    ok = lambda v: (F.length(v) > 2) & (F.length(v) < 150)

    def per_keyword(word: str, lines: Column) -> Column:
        w = re.escape(word.strip())
        inline = T.let(F.btrim(T.collapse_blanks(F.regexp_extract(
            "text", rf"(?i){w}\s*[:\-=–—]?\s*([A-Za-z0-9,./()'\"\-& ]{{2,150}})", 1)), F.lit(":,.-= ")),
            lambda v: F.when(ok(v), F.struct(v.alias("value"), F.lit(KEYWORD_CONFIDENCE["inline"]).alias("confidence"))))

        def on_line(x: Column, i: Column) -> Column:
            tail = T.strip(F.regexp_extract(x, rf"(?i){w}\s*[:\-=–—]?\s*(.*)", 1))
            below = T.strip(F.get(lines, i + 1))
            return F.when(x.rlike(f"(?i){w}"), F.when(ok(tail), F.struct(
                tail.alias("value"), F.lit(KEYWORD_CONFIDENCE["tail"]).alias("confidence"))).when(
                ok(below) & ~below.contains(":"),
                F.struct(below.alias("value"), F.lit(KEYWORD_CONFIDENCE["next"]).alias("confidence"))))

        by_line = F.get(F.filter(F.transform(lines, on_line), lambda h: h.isNotNull()), F.lit(0))
        return F.coalesce(inline, by_line)

    def per_field(words: Sequence[str]):
        return lambda lines: F.coalesce(*[per_keyword(w, lines) for w in words])

    fields = F.array(*[
        F.struct(F.lit(f).alias("field_key"), T.let(
            F.split("text", "\n", -1), per_field(ws)).alias("h"))
        for f, ws in keywords.items()])
    return docs.select(key, F.explode(fields).alias("f")).select(key, "f.field_key", "f.h.*").filter(F.col("value").isNotNull())


def _chunk(ls: Column, is_hit: Callable[[Column], Column]) -> Column:
    """Lines around every hit, with a mark at each gap; the first lines when nothing hits."""
    hits = F.filter(F.transform(ls, lambda x, i: F.when(is_hit(x), i + 1)), lambda i: i.isNotNull())

    def cut(hs: Column) -> Column:
        n = F.size(ls)
        # runs of kept lines: a run starts where the window of a hit does not touch the one before
        at = F.transform(hs, lambda h, k: F.struct(
            F.greatest(h - CHUNK_BEFORE, F.lit(1)).alias("a"), F.least(h + CHUNK_AFTER, n).alias("b"),
            F.coalesce(F.get(hs, k - 1) + CHUNK_AFTER, F.lit(0)).alias("before"),
            (k == 0).alias("first")))
        pieces = F.transform(at, lambda s: F.when(
            s["first"] | (s["a"] > s["before"] + 1),
            F.concat(F.lit(GAP + "\n"), F.array_join(F.slice(ls, s["a"], s["b"] - s["a"] + 1), "\n"))).otherwise(
            F.array_join(F.slice(ls, F.least(s["before"], n) + 1, F.greatest(s["b"] - F.least(s["before"], n), F.lit(0))), "\n")))
        kept = F.filter(F.transform(pieces, lambda p, k: F.when(
            F.get(at, k)["first"] | (F.get(at, k)["b"] > F.get(at, k)["before"]), p)), lambda p: p.isNotNull())
        return F.when(F.size(hs) > 0, F.substring(F.array_join(kept, "\n"), 1, CHUNK_CHARS)).otherwise(
            F.array_join(F.slice(ls, 1, CHUNK_LINES), "\n"))

    return T.let(hits, cut)


def relevant_chunks(docs: DataFrame, terms: Sequence[str], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Lines around every term hit, with a mark at each gap; the first lines when nothing hits."""
    wanted = [t.lower() for t in terms if t.strip()]
    return docs.select(*keys, T.let(F.split("text", "\n", -1), lambda ls: _chunk(
        ls, lambda x: T.contains_any(F.lower(x), wanted))).alias("chunk"))


def _request_id(key: str) -> Column:
    return F.concat_ws(":", F.col(key).cast("string"), T.slug(F.col("field_name")))


def fallback_queue(resolved: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fields without any candidate become request rows for an outside model."""
    return resolved.filter(F.col("fuzzy").isNull()).withColumns({
        "request_id": _request_id(key), "field_code": T.slug(F.col("field_name")), "answer_confidence": F.lit(ANSWER_CONFIDENCE)})


def work_list(queue: DataFrame, docs: DataFrame, keywords: DataFrame, key: str = "doc_id") -> DataFrame:
    """The queue with what a model needs: label, keywords and the part of the text around them.

    ``keywords`` is ``(field_name, alias)``; a field without any is looked for by its own name. A document's requests meet its text
    once, whatever their number, and its lines are split once. Documents without text ask nothing; repeated rows of a request count once.
    """
    words = keywords.filter(T.strip(F.col("alias")) != "").groupBy("field_name").agg(F.array_sort(F.collect_set("alias")).alias("keywords"))
    asked = queue.select(key, "field_name", "field_code", "request_id", "answer_confidence").distinct().join(words, "field_name", "left")
    request = F.struct("request_id", "field_name", "field_code", F.col("field_name").alias("label"),
                       F.coalesce("keywords", F.array("field_name")).alias("keywords"), "answer_confidence")
    by_doc = asked.groupBy(key).agg(F.collect_list(request).alias("asked"))

    def with_chunk(ls: Column) -> Column:
        return F.transform("asked", lambda a: F.struct(a.alias("r"), _chunk(
            ls, lambda x: F.exists(a["keywords"], lambda k: F.contains(F.lower(x), F.lower(k)))).alias("chunk")))

    rows = by_doc.join(docs.select(key, "text"), key).select(key, F.explode(T.let(F.split("text", "\n", -1), with_chunk)).alias("w"))
    return rows.select(key, "w.r.*", "w.chunk").filter("chunk <> ''")


def merge_answers(resolved: DataFrame, answers: DataFrame, key: str = "doc_id") -> DataFrame:
    """Answers ``(request_id, answer)`` fill the fields that have no value; of several the smallest not blank counts."""
    said = T.blank_to_null(F.col("answer"))
    a = answers.select("request_id", said.alias("answer")).filter(F.col("answer").isNotNull()).groupBy("request_id").agg(F.min("answer").alias("answer"))
    filled = F.col("value").isNull() & F.col("answer").isNotNull()
    return resolved.withColumn("request_id", _request_id(key)).join(a, "request_id", "left").withColumns({
        "confidence": F.when(filled, ANSWER_CONFIDENCE).otherwise(F.col("confidence")),
        "reason": F.when(~filled, F.col("reason")),
        "value": F.coalesce("value", "answer"),
    }).drop("answer", "request_id")


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """First pattern in order with a non-empty group, blanks collapsed."""
    return F.coalesce(*[F.nullif(T.collapse_blanks(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])
