"""Multipart credential linking in texts (DataFrame functions only).

Strong spans (assignments, access ids, long hex runs) are always reported. Weak parts - account names, endpoints and
random-looking strings - are common in harmless text; each is reported only if complementary parts stand within SCOPE
characters: an account name needs a secret, a string needs an access id or account name, an endpoint needs both. Parts
meet in an interval join: spans are dealt into bins of SCOPE characters, each weak part looks into its own bin and the two
beside it. So the rows of a join key are bounded by the bin, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .base import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ENDPOINT = r"""(?<![A-Za-z])(?:https?|ftps?|wss?|postgres|postgresql|mysql|mongodb|redis|amqp|ldap|s3)://[A-Za-z0-9._~%:/?#@!$&*+,;=-]{4,}"""
ACCOUNT = r"""(?<![A-Za-z])(?i:user(?:_?name)?|login|client_?id|account(?:_?id)?|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,99}[0-9])(?=[0-9+/_-]{0,99}[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
SCOPE = 400
#: in the order in which spans with one start are listed; the first three are strong
KINDS = ["assign", "access", "hex", "endpoint", "account", "random"]
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, near: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """All leftmost matches that do not overlap, as code point offsets.

    Splitting at the pattern gives the texts between the matches, so that running lengths give the offsets. ``near`` is
    a cheap test that is true for every text with a match.
    """
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    both = F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                      lambda n, hit: F.struct(n.alias("n"), F.length(hit).alias("hit"), (F.lit(True) if keep is None else keep(hit)).alias("keep")))
    none = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["n"]
        end = start + x["hit"]
        found = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"].isNotNull() & x["keep"], F.concat(acc["found"], found)).otherwise(acc["found"]).alias("found"))

    all_of_it = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(near, all_of_it).otherwise(none)


def _strong(text: Column) -> Column:
    value_long = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    return F.concat(_spans(text, ASSIGN, 0, text.rlike("(?i)passw|secret|token|api_?key"), value_long),
                    _spans(text, ACCESS, 1, text.contains("AKIA")), _spans(text, HEX, 2, text.rlike("[0-9a-f]{32}")))


def _weak(text: Column) -> Column:
    return F.concat(_spans(text, ENDPOINT, 3, text.contains("://")),
                    _spans(text, ACCOUNT, 4, text.rlike("(?i)user|login|client_?id|account|access_?key")),
                    _spans(text, RANDOM, 5, text.rlike("[A-Za-z0-9+/_-]{20}") & text.rlike(RANDOM)))


def listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _linked(candidates: DataFrame) -> DataFrame:
    """text_key, linked: the weak spans with complementary parts in reach. candidates: text_key, spans; one row a text."""
    parts = candidates.select("text_key", F.explode("spans").alias("s")).select("text_key", "s.*")
    role = F.when(F.col("kind").isin(1, 4), 0).when(F.col("kind").isin(0, 2, 5), 1).otherwise(2)
    right = parts.select("text_key", F.floor(F.col("start") / SCOPE).alias("bin"), F.struct("start", "kind", "end").alias("other"), role.alias("role"))
    weak = parts.where("kind >= 3").select("text_key", F.struct("start", "kind", "end").alias("s"))
    left = weak.withColumn("bin", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("s.start") / SCOPE) + d)))
    near = (F.abs(F.col("other.start") - F.col("s.start")) <= SCOPE) & (F.col("other") != F.col("s"))
    roles = left.join(right, ["text_key", "bin"]).where(near).groupBy("text_key", "s").agg(
        F.max(F.col("role") == 0).alias("names"), F.max(F.col("role") == 1).alias("secrets"))
    good = (F.when(F.col("s.kind") == 4, F.col("secrets")).when(F.col("s.kind") == 5, F.col("names")).otherwise(F.col("names") & F.col("secrets")))
    return roles.where(good).groupBy("text_key").agg(F.collect_list("s").alias("linked"))


def credential_spans(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, strong and linked (arrays of start, kind, end).

    Offsets are code points, end exclusive. Null and empty texts have no spans; repeated rows come back as often as they
    are given; equal texts are linked once. Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", F.md5("text").alias("text_key"), _strong(F.col("text")).alias("strong"), _weak(F.col("text")).alias("weak"))
    apart = lambda w: ~F.exists("strong", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    rows = cut(found.select("doc_id", "text_key", "strong", F.filter("weak", apart).alias("weak")), "spans")
    # a lone part can have no partner; equal texts have equal spans
    several = rows.where((F.size("weak") > 0) & (F.size("weak") + F.size("strong") > 1))
    candidates = several.groupBy("text_key").agg(F.first(F.concat("strong", "weak")).alias("spans"))
    linked = cut(_linked(candidates), "linked")
    return rows.join(linked, "text_key", "left").select("doc_id", "strong", F.coalesce("linked", F.array().cast(SPANS)).alias("linked"))
