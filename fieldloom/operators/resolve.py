"""Resolution: requested field names against candidates (exact, normalised, gated fuzzy and semantic), and ranking.

Similarity depends on the label only, so it is computed once per distinct label and joined back on the label; the
request list is a template's field list, a checked small list that travels inside the plan.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import similarity as Sim
from ..functions import text as T
from . import discovery as D

# ---- fixed values -------------------------------------------------------------------------
WEAK_TOKENS = "name number area address no date id code details information value s es".split()
STRONG_TOKENS = (
    "owner survey village industrial residential applicant purchaser door plot ward taluka mandal district city town "
    "layout authority prohibited opinion inspection valuation buyer seller vendor vendee builder developer agreement "
    "deed permit permission mortgage extent built plinth carpet land tenure"
).split()
BANNED_VALUE_WORDS = {
    "door": ["ltd", "pvt", "company", "bank", "synergy", "synergy pvt", "corporation"],
    "plot": ["ltd", "pvt", "company", "bank"],
    "survey": ["ltd", "pvt", "company", "bank"],
    "owner": ["ltd", "pvt", "bank"],
    "purchaser": ["ltd", "pvt", "bank"],
}
SYNONYMS = [
    "owner applicant borrower proprietor landlord lessor".split(),
    "purchaser buyer vendee".split(),
    "vendor seller".split(),
    "tenant lessee occupant".split(),
    "amount price cost value consideration premium rs rupees".split(),
    "date day month year".split(),
    "address location premises property".split(),
]
FUZZY_AT_LEAST = 0.6
SEMANTIC_AT_LEAST = 0.75
WEIGHTS = {"semantic": 0.4, "fuzzy": 0.25, "ocr": 0.15, "context": 0.1, "validation": 0.1}
ACCEPT_AT_LEAST = 0.65
REVIEW_BELOW = 0.7
CONTEXT_RADIUS = 5
NO_MATCH = "No matching candidate found"
PERMIT_PATTERNS = [
    r"PERMIT\s*NO\.?\s*[:\s-]*\s*([A-Z0-9/\-_.()]{4,})",
    r"FILE\s*NO\.?\s*[:\s-]*\s*([A-Z0-9/\-_.()]{4,})",
    r"BUILDING\s*PERMISSION\s*NUMBER\s*[:\s-]*\s*([A-Z0-9/\-_.()]{4,})",
]
RERA_PATTERNS = [
    r"RERA\s*(?:REGISTRATION|REG|NO)?\.?\s*[:\s-]*\s*([A-Z0-9/\-_.()]{4,})",
    r"RERA.*?([A-Z0-9/\-_.()]{4,})",
]
SURVEY_PATTERNS = [
    r"SURVEY\s*NO\.?\s*[:\-]?\s*([A-Za-z0-9/\-,\s()]+)",
    r"SY\.?\s*NO\.?\s*[:\-]?\s*([A-Za-z0-9/\-,\s()]+)",
]
PLOT_PATTERNS = [r"PLOT\s*NO\.?\s*[:\-]?\s*([A-Za-z0-9/\-,\s()]+)"]
FLAT_PATTERNS = [r"FLAT\s*NO\.?\s*[:\-]?\s*([A-Za-z0-9/\-,\s()]+)"]
# the first group whose word occurs in the request applies; one_line keeps the first line of the hit
REQUEST_PATTERNS = [
    (("permit", "permission"), PERMIT_PATTERNS, False),
    (("rera",), RERA_PATTERNS, False),
    (("survey",), SURVEY_PATTERNS, True),
    (("plot",), PLOT_PATTERNS, True),
    (("flat",), FLAT_PATTERNS, True),
]
REGEX_CONFIDENCE = 0.90
STRATEGY_RANK = {"Exact": 5, "Normalized": 4, "Table": 3, "Regex": 2, "Context": 1}
# -------------------------------------------------------------------------------------------

MAX_REQUESTS = 2000


def check_requests(requests: Sequence[str]) -> list[str]:
    """Requests are one template's field names; a list beyond any template belongs in a table, not in a plan."""
    names = [r.strip() for r in requests if r and r.strip()]
    if len(names) > MAX_REQUESTS:
        raise ValueError(f"{len(names)} requested fields; the limit for one run is {MAX_REQUESTS}")
    return list(dict.fromkeys(names))


def word_set(text: str, split: str = r"\s+") -> list[str]:
    return list(dict.fromkeys(w for w in re.split(split, text.lower()) if w))


def banned_pattern(request: str) -> str | None:
    words = [w for key, ws in BANNED_VALUE_WORDS.items() if key in request.lower() for w in ws]
    return r"\b(" + "|".join(dict.fromkeys(words)) + r")\b" if words else None


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def request_array(requests: Sequence[str]) -> Column:
    """The request list with its word sets as one literal array."""
    rows = []
    for i, name in enumerate(check_requests(requests)):
        specific = [w for w in word_set(name) if w not in WEAK_TOKENS]
        strong = [w for w in word_set(name, r"\W+") if w in STRONG_TOKENS]
        groups = [str(g) for g, ws in enumerate(SYNONYMS) if set(ws) & set(specific)]
        rows.append(F.struct(
            F.lit(i).alias("ord"), F.lit(name).alias("name"), _strings(specific).alias("specific"),
            _strings(strong).alias("strong"), _strings(groups).alias("groups"),
            F.lit(banned_pattern(name)).cast("string").alias("banned")))
    return F.array(*rows)


def distinct_labels(labels: DataFrame) -> DataFrame:
    """Distinct labels over all cores: they are few bytes, so adaptive execution would put them into one task, but costly to judge."""
    return labels.select("label").distinct().repartition(4 * labels.sparkSession.sparkContext.defaultParallelism, "label")


def label_features(labels: DataFrame, *kept: str) -> DataFrame:
    words = F.filter(F.split(F.lower("label"), T.BLANK + "+", -1), lambda w: w != "")
    specific = F.array_except(F.array_distinct(words), _strings(WEAK_TOKENS))
    strong = F.array_intersect(F.split(F.lower("label"), r"[^\p{L}\p{N}_]+", -1), _strings(STRONG_TOKENS))
    return labels.select("label", *kept, specific.alias("specific"), strong.alias("strong")).withColumn(
        "groups", F.array_compact(F.array(*[
            F.when(F.arrays_overlap("specific", _strings(ws)), F.lit(str(g))) for g, ws in enumerate(SYNONYMS)])))


def match_kind(r: Column) -> Column:
    """0 exact, 1 normalised, 2 open to similarity, null when a gate rejects the pair (columns of label_features)."""
    spec, strong, groups = F.col("specific"), F.col("strong"), F.col("groups")
    related = (
        (F.size(spec) == 0) | (F.size(r["specific"]) == 0)
        | F.arrays_overlap(spec, r["specific"])
        | F.exists(spec, lambda w: F.exists(r["specific"], lambda q: w.contains(q) | q.contains(w)))
        | F.arrays_overlap(groups, r["groups"])
    )
    strong_ok = (F.size(strong) == 0) | (F.size(r["strong"]) == 0) | F.arrays_overlap(strong, r["strong"])
    return (
        F.when(F.col("label") == r["name"], 0)
        .when(F.lower(T.strip(F.col("label"))) == F.lower(r["name"]), 1)
        .when(related & strong_ok, 2)
    )


def exact_matches(cands: DataFrame, requests: Sequence[str]) -> DataFrame:
    """Candidates with the requests they equal, case and outer blanks aside (kind 0 where the label is the name itself, else 1)."""
    rows = [(i, name, banned_pattern(name)) for i, name in enumerate(check_requests(requests))]
    names = cands.sparkSession.createDataFrame(rows, "field_ord int, field_name string, banned string").withColumn("_key", F.lower("field_name"))
    met = cands.withColumn("_key", F.lower(T.strip(F.col("label")))).join(F.broadcast(names), "_key").drop("_key")
    return met.withColumn("kind", F.when(F.col("label") == F.col("field_name"), 0).otherwise(1))


def gated_pairs(labels: DataFrame, requests: Sequence[str], *kept: str) -> DataFrame:
    """Pairs (label, request) that pass the word gates, over distinct labels; with the columns named in ``kept`` where the labels are distinct already."""
    pairs = F.filter(
        F.transform(request_array(requests), lambda r: F.struct(
            r["ord"].alias("field_ord"), r["name"].alias("field_name"), r["banned"].alias("banned"),
            match_kind(r).alias("kind"))),
        lambda p: p["kind"].isNotNull())
    return (
        label_features(labels if kept else distinct_labels(labels), *kept)
        .select("label", *kept, F.explode_outer(pairs).alias("p")).filter(F.col("p").isNotNull()).select("label", *kept, "p.*")
    )


def scored_pairs(labels: DataFrame, requests: Sequence[str], vectors: DataFrame | None = None) -> DataFrame:
    """Gated pairs with both similarities, kept when they match. ``vectors(text, vec)`` replaces the trigram vectors."""
    if vectors is None:
        # a label's trigrams are hashed once, not for each request, and a request's vector is made once
        hashed = distinct_labels(labels).withColumn("hs", Sim.trigram_hashes(F.col("label"))).withColumn("n", Sim.hashes_norm(F.col("hs")))
        pairs = gated_pairs(hashed, requests, "hs", "n")
        names = [(r,) for r in check_requests(requests)]
        own = labels.sparkSession.createDataFrame(names, "field_name string").withColumn("vec", Sim.trigram_vector(F.col("field_name")))
        own = own.withColumn("vec_norm", F.sqrt(Sim.dot(F.col("vec"), F.col("vec"))))
        pairs = pairs.join(F.broadcast(own), "field_name")
        sem = Sim.hashes_cosine01(F.col("vec"), F.col("vec_norm"), F.col("hs"), F.col("n"))
    else:
        pairs = gated_pairs(labels, requests)
        pairs = (
            pairs.join(vectors.select(F.col("text").alias("label"), F.col("vec").alias("label_vec")), "label", "left")
            .join(vectors.select(F.col("text").alias("field_name"), F.col("vec").alias("field_vec")), "field_name", "left"))
        sem = F.coalesce(Sim.cosine01(F.col("field_vec"), F.col("label_vec")), F.lit(0.0))
    scored = pairs.withColumns({
        "fuzzy": Sim.token_sort_ratio(F.col("field_name"), F.col("label")), "semantic": sem,
    })
    return scored.filter((F.col("kind") < 2) | (F.col("fuzzy") >= FUZZY_AT_LEAST) | (F.col("semantic") >= SEMANTIC_AT_LEAST)).select(
        "label", "field_ord", "field_name", "banned", "kind", "fuzzy", "semantic")


def drop_banned(rows: DataFrame) -> DataFrame:
    """Rows whose value holds a word that the request bans are dropped."""
    return rows.filter(F.col("banned").isNull() | ~F.regexp_like(F.lower("value"), F.col("banned")))


def retrieve(cands: DataFrame, requests: Sequence[str], vectors: DataFrame | None = None) -> DataFrame:
    """Candidates of every requested field: equi-join of the candidates with the matching labels."""
    return drop_banned(cands.join(scored_pairs(cands, requests, vectors), "label"))


def retrieve_from(docs: DataFrame, requests: Sequence[str], key: str = "doc_id", vectors: DataFrame | None = None) -> DataFrame:
    """The same from documents: only candidates whose label can match go through the duplicate merge.

    Labels are read first, without merging; equal ones but for case and blanks merge, so all spellings of a match are kept.
    """
    good = D.quality_gate(D.discover(docs, [key]))
    # read twice, and small beside the candidates
    pairs = scored_pairs(good, requests, vectors).persist()
    spelt = lambda: F.lower(T.strip(F.col("label"))).alias("_key")
    wanted = good.withColumn("_key", spelt()).join(pairs.select(spelt()).distinct(), "_key", "left_semi").drop("_key")
    return drop_banned(D.merge_duplicates(wanted, [key]).join(pairs, "label"))


def _request_patterns(name: str) -> tuple[list[str], bool]:
    for words, patterns, one_line in REQUEST_PATTERNS:
        if any(w in name.lower() for w in words):
            return patterns, one_line
    return [], False


def request_regex_hits(docs: DataFrame, requests: Sequence[str], key: str = "doc_id") -> DataFrame:
    """First hit of every pattern that a request's words select, over the whole text."""
    found = []
    for i, name in enumerate(check_requests(requests)):
        patterns, one_line = _request_patterns(name)
        for j, p in enumerate(patterns):
            raw = T.strip(F.regexp_extract("text", "(?i)" + p, 1))
            val = F.btrim(F.regexp_replace(raw, r"^[ :\-=]+", ""), F.lit("., "))
            val = T.strip(F.substring_index(val, "\n", 1)) if one_line else val
            found.append(F.struct(F.lit(i).alias("field_ord"), F.lit(name).alias("field_name"),
                                  F.lit(j).alias("pattern_rank"), val.alias("value")))
    if not found:
        found = [F.struct(F.lit(-1).alias("field_ord"), F.lit("").alias("field_name"), F.lit(0).alias("pattern_rank"),
                          F.lit("").alias("value"))]
    return docs.select(key, F.explode(F.array(*found)).alias("h")).select(key, "h.*").filter(F.length("value") >= 2)


def with_regex_candidates(retrieved: DataFrame, docs: DataFrame, requests: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Add regex hits whose value no retrieved candidate of the field holds (an anti join on the value)."""
    hits = request_regex_hits(docs, requests, key).select(
        key, F.col("field_name").alias("label"), "field_ord", "field_name", F.lit(0).alias("kind"), "value",
        F.lit(None).cast("int").alias("source_line"), F.lit(REGEX_CONFIDENCE).alias("ocr_confidence"), F.lit("regex").alias("strategy"),
        F.struct(F.lit(9).alias("k0"), F.col("pattern_rank").alias("k1"), F.lit(0).alias("k2"), F.lit(0).alias("k3"), F.lit(0).alias("k4")).alias("ord"),
        F.lit(1.0).alias("fuzzy"), F.lit(1.0).alias("semantic"))
    cols = [c for c in hits.columns if c not in (key, "field_ord")]
    own = retrieved.select(*hits.columns, F.lit(False).alias("_hit"))
    # both meet in one grouping of a field's equal values, so that the candidates are found once
    row = F.struct(*cols)
    g = own.unionByName(hits.withColumn("_hit", F.lit(True))).groupBy(key, "field_ord", F.lower(T.strip(F.col("value"))).alias("value_key")).agg(
        F.collect_list(F.when(~F.col("_hit"), row)).alias("own"),
        # equal values of later patterns are dropped in favour of the first
        F.min_by(F.when(F.col("_hit"), row), F.when(F.col("_hit"), F.struct("ord.k1", "value"))).alias("hit"))
    kept = F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("hit"))
    return g.select(key, "field_ord", F.explode_outer(kept).alias("r")).filter(F.col("r").isNotNull()).select(key, "field_ord", "r.*").select(*hits.columns)


def neighbour_requests(docs: DataFrame, requests: Sequence[str], key: str = "doc_id") -> DataFrame:
    """Per line the requested names (lower-cased) found in the lines around it, the line itself left out."""
    names = _strings(list(dict.fromkeys(r.lower() for r in check_requests(requests))))

    def around(ls: Column) -> Column:
        hits = F.transform(ls, lambda x: F.filter(names, lambda r: F.lower(x).contains(r)))
        return T.let(hits, lambda hs: F.transform(hs, lambda _, i: T.let(
            F.greatest(i + 1 - CONTEXT_RADIUS, F.lit(1)),
            lambda a: F.array_distinct(F.flatten(F.concat(
                F.slice(hs, a, i + 1 - a), F.slice(hs, i + 2, CONTEXT_RADIUS)))))))

    return (
        docs.select(key, F.posexplode_outer(T.let(T.split_lines(F.col("text")), around)).alias("pos", "near"))
        .filter(F.size("near") > 0)
        .select(key, (F.col("pos") + 1).alias("source_line"), "near")
    )


def validation_score(field: Column, value: Column) -> Column:
    q, v = F.lower(field), value
    n = F.length(T.digits(v))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return (
        F.when(F.coalesce(v, F.lit("")) == "", 0.0)
        .when(q.contains("email"), flag(T.strip(v).rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")))
        .when(T.contains_any(q, ["phone", "mobile", "contact"]), flag((n >= 10) & (n <= 15)))
        .when(q.contains("date"), flag(v.rlike(r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}")))
        .when(T.contains_any(q, ["amount", "value", "rupee", "rs", "cost", "price"]), flag(v.rlike(r"\d")))
        .when(q.contains("pan"), flag(v.rlike(r"[A-Za-z]{5}\d{4}[A-Za-z]")))
        .when(T.contains_any(q, ["aadhaar", "aadhar"]), flag(n == 12))
        .otherwise(1.0)
    )


def score(retrieved: DataFrame, docs: DataFrame, requests: Sequence[str], key: str = "doc_id",
          weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Context, validation and weighted score of every retrieved candidate."""
    near = neighbour_requests(docs, requests, key)
    rows = retrieved.join(near, [key, "source_line"], "left")
    others = F.size(F.array_remove(F.coalesce("near", F.array().cast("array<string>")), F.lower("field_name")))
    rows = rows.withColumns({
        "context": F.least(F.lit(1.0), others * F.lit(0.2)),
        "validation": validation_score(F.col("field_name"), F.col("value")),
    }).drop("near")
    final = (
        weights["semantic"] * F.col("semantic") + weights["fuzzy"] * F.col("fuzzy") + weights["ocr"] * F.col("ocr_confidence")
        + weights["context"] * F.col("context") + weights["validation"] * F.col("validation")
    )
    return rows.withColumn("final_score", final)


def rank_key() -> Column:
    """Larger is better; equal scores keep the discovery order."""
    return F.struct(
        "final_score", "ocr_confidence", "fuzzy", "semantic",
        *[(-F.col(f"ord.k{i}")).alias(f"t{i}") for i in range(5)])


def ranked(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """All candidates with their rank per document and field (a document's candidates of one field)."""
    order = [F.desc("final_score"), F.desc("ocr_confidence"), F.desc("fuzzy"), F.desc("semantic"), F.asc("ord")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(key, "field_ord").orderBy(*order)))


def best(scored: DataFrame, key: str = "doc_id") -> DataFrame:
    """The top candidate per document and field, by aggregation."""
    row = F.struct(rank_key().alias("rk"), F.struct(
        "label", "value", "source_line", "strategy", "ocr_confidence", "fuzzy", "semantic", "context", "validation",
        "final_score").alias("r"))
    return scored.groupBy(key, "field_ord", "field_name").agg(F.max(row).alias("m")).select(
        key, "field_ord", "field_name", "m.r.*")


def compatible_strategy(strategy: Column, label: Column, field: Column) -> Column:
    s = F.lower(strategy)
    return (
        F.when(s.contains("regex"), "Regex").when(s.contains("table"), "Table")
        .when(s.contains("context") | s.contains("llm"), "Context")
        .when((s.contains("key_value") | s.contains("nearby_label")) & (label == field), "Exact")
        .otherwise("Normalized")
    )


def request_rows(docs: DataFrame, requests: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One row per document and requested field."""
    return docs.select(key, F.posexplode(_strings(check_requests(requests))).alias("field_ord", "field_name"))


def accept(docs: DataFrame, top: DataFrame, requests: Sequence[str], key: str = "doc_id") -> DataFrame:
    """One row per document and requested field: the accepted value, or the reason why there is none."""
    rows = request_rows(docs, requests, key).join(top, [key, "field_ord", "field_name"], "left")
    ok = F.coalesce(F.col("final_score") >= ACCEPT_AT_LEAST, F.lit(False))
    return rows.select(
        key, "field_ord", "field_name",
        F.when(ok, F.col("value")).alias("value"),
        F.when(ok, F.col("final_score")).otherwise(0.0).alias("confidence"),
        (~ok | (F.col("final_score") < REVIEW_BELOW)).alias("needs_review"),
        F.when(ok, F.col("label")).alias("matched_label"),
        F.when(ok, F.col("source_line")).alias("source_line"),
        F.when(ok, compatible_strategy(F.col("strategy"), F.col("label"), F.col("field_name"))).alias("strategy"),
        F.when(F.col("final_score").isNull(), NO_MATCH).when(~ok, F.format_string(
            "Best candidate score (%.3f) below threshold " + str(ACCEPT_AT_LEAST), F.col("final_score"))).alias("reason"),
        "semantic", "fuzzy", "context", "validation", "ocr_confidence",
    )


def resolve(docs: DataFrame, requests: Sequence[str], key: str = "doc_id", cands: DataFrame | None = None,
            vectors: DataFrame | None = None) -> DataFrame:
    """Documents and requested names to accepted values."""
    found = with_regex_candidates(
        retrieve_from(docs, requests, key, vectors) if cands is None else retrieve(cands, requests, vectors), docs, requests, key)
    return accept(docs, best(score(found, docs, requests, key), key), requests, key)


# ---- names and keys -------------------------------------------------------------------------

def canonical_keys(names: DataFrame, display: DataFrame, aliases: DataFrame, dict_rank: int | None = None,
                   column: str = "name") -> DataFrame:
    """Display name to field key: exact mapping, any-case mapping, first dictionary key owning the alias, slug."""
    n = names.withColumns({"_n": T.strip(F.col(column)), "_k": F.lower(T.strip(F.col(column)))})
    exact = display.select(F.col("name").alias("_n"), F.col("field_key").alias("_exact"))
    loose = display.groupBy(F.lower("name").alias("_k")).agg(F.min_by("field_key", "name_rank").alias("_loose"))
    owned = aliases if dict_rank is None else aliases.filter(F.col("dict_rank") == dict_rank)
    owner = owned.groupBy(F.lower(T.strip(F.col("alias"))).alias("_k")).agg(
        F.min_by("field_key", F.struct("dict_rank", "key_rank")).alias("_owned"))
    return (
        n.join(exact, "_n", "left").join(loose, "_k", "left").join(owner, "_k", "left")
        .withColumn("canonical_name", F.coalesce("_exact", "_loose", "_owned", F.nullif(T.slug(F.col("_n")), F.lit(""))))
        .drop("_n", "_k", "_exact", "_loose", "_owned")
    )


def expand_aliases(names: DataFrame, aliases: DataFrame, column: str = "name") -> DataFrame:
    """A name and every alias of every key that lists it, in first-seen order without repeats."""
    lc = lambda c: F.lower(T.strip(F.col(c)))
    owners = aliases.select(lc("alias").alias("_k"), "dict_rank", "field_key", "key_rank").distinct()
    siblings = aliases.select("dict_rank", "field_key", "key_rank", T.strip(F.col("alias")).alias("alias"), "alias_rank")
    listed = (
        names.select(F.col(column), lc(column).alias("_k")).join(owners, "_k").join(siblings, ["dict_rank", "field_key", "key_rank"])
        .select(column, "alias", F.struct("dict_rank", "key_rank", "alias_rank").alias("r"))
    )
    own = names.select(column, T.strip(F.col(column)).alias("alias"), F.struct(
        F.lit(-1).alias("dict_rank"), F.lit(0).alias("key_rank"), F.lit(0).alias("alias_rank")).alias("r"))
    return own.unionByName(listed).groupBy(column, "alias").agg(F.min("r").alias("rank"))


def display_name(keys: DataFrame, display: DataFrame, aliases: DataFrame, column: str = "field_key") -> DataFrame:
    """Field key to display name: first mapping, else first alias, else the key's words in title case."""
    by_map = display.groupBy(F.col("field_key").alias(column)).agg(F.min_by("name", "name_rank").alias("_m"))
    by_alias = aliases.groupBy(F.col("field_key").alias(column)).agg(
        F.min_by("alias", F.struct("dict_rank", "alias_rank")).alias("_a"))
    return keys.join(by_map, column, "left").join(by_alias, column, "left").withColumn(
        "display_name", F.coalesce("_m", "_a", T.title_case(F.regexp_replace(column, "_", " ")))).drop("_m", "_a")


#: requests, and vectors, of one cell of the grid
SIDE, LEAST_SIDE = 131_072, 2_048


def vector_join(requests: DataFrame, vectors: DataFrame, threshold: float = SEMANTIC_AT_LEAST, side: int = SIDE) -> DataFrame:
    """Pairs of request (request_id, request_vec) and candidate (vec_id, vec) whose mapped cosine reaches the threshold, above 0.

    Every request meets every candidate, in the cells of a grid: a request is dealt to a row and stands in each column, a
    candidate to a column and in each row. A cell holds about ``side`` of both, whatever the tables' sizes, and multiplies them
    slice after slice, so memory is bounded and cells run in parallel; the work grows with requests x candidates. Vectors
    of norm 0, with nulls or of different lengths are near nothing; a vector does not meet its own id. The other columns of
    both sides are kept, without the vectors.
    """
    if threshold <= 0:
        raise ValueError("at a threshold of 0 every pair would be near")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_requests, n_vectors = requests.count(), vectors.count()
    rows = max(1, math.ceil(n_requests / side))
    columns = max(1, math.ceil(n_vectors / side), min(math.ceil(n_vectors / LEAST_SIDE), 2 * cores))
    struct = lambda df, vec: df.schema.__class__([f for f in df.schema.fields if f.name != vec])
    req_type, cand_type = struct(requests, "request_vec"), struct(vectors, "vec")

    def dealt(df: DataFrame, vec: str, id_: str, own: str, parts: int, every: str, others: int, req: Column, cand: Column) -> DataFrame:
        v = F.col(vec).cast("array<double>") if df.schema[vec].dataType.elementType.typeName() != "float" else F.col(vec)
        there = df.where(Sim.dot(F.col(vec), F.col(vec)) > 0)
        return there.select(F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(every),
                            F.size(vec).alias("dim"), v.alias("v"), req.alias("req"), cand.alias("cand"))

    of = lambda t: F.struct(*[f.name for f in t.fields])
    both = dealt(requests, "request_vec", "request_id", "row", rows, "column", columns, of(req_type), F.lit(None).cast(cand_type)).select("row", "column", "dim", "v", "req", "cand")
    both = both.unionByName(dealt(vectors, "vec", "vec_id", "column", columns, "row", rows, F.lit(None).cast(req_type), of(cand_type)))
    out = f"req {req_type.simpleString()}, cand {cand_type.simpleString()}, similarity double"
    near = both.groupBy("row", "column", "dim").applyInArrow(Sim.near_in_cell(threshold), out)
    return near.select("req.*", "cand.*", "similarity").where("request_id != vec_id")
