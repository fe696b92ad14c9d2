"""Balanced label propagation: shards of even row counts in which linked documents stand together.

A node is a group of equal texts; a group that would fill more than a sixteenth of a shard, or has over a million rows,
is split into several nodes.
Nodes are linked through hubs: the group itself (its parts) and every distinct line of LONG_LINE characters or more
(documents that share a passage; passages in differently broken or edited lines give no link). A hub costs a row for each
of its nodes, never a pair. A node follows the hub with the largest share in one shard, so rare lines go before common
ones. Each round joins nodes with the shard that most rows of their hubs are in, and lets the nodes with the largest
gain move there as long as the shard's quota allows. At the end every shard keeps at most its exact share of rows; what
is over, and all unlinked documents, fill the free slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .base import cut, ranked

SHARDS = 24
ROUNDS = 4
LONG_LINE = 40
GAIN_BINS = 40
PART_ROWS = 1_000_000


def byte_size(text: Column) -> Column:
    """UTF-8 bytes and 8 for the length; a null text has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _line_hashes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(x) >= LONG_LINE)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x, F.lit(1))))


def narrow_documents(docs: DataFrame) -> DataFrame:
    """key columns only: doc_id, size, text_crc32, group hash and link hashes. Null texts are one group and have crc 0."""
    text = F.col("text")
    return docs.select(
        "doc_id", byte_size(text).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(text, F.coalesce(F.octet_length(text), F.lit(-1))).alias("group"),
        _line_hashes(text).alias("links"))


def balanced_shards(narrow: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in its shard); row counts of shards are at most one apart.

    ``narrow`` has doc_id, group (rows of equal groups belong together) and links (array of hashes, nulls ignored), and
    columns that are carried along. Equal rows are dealt like different ones. Empty table: empty result.
    """
    narrow = cut(narrow, "narrow")
    n = narrow.count()
    most = max(1, min(n // (shards * 16), PART_ROWS))
    groups = narrow.groupBy("group").agg(F.count("*").alias("in_group"))
    # at most 16 * shards groups fill more than a sixteenth of a shard, and n / PART_ROWS have more rows than that
    large = groups.where(F.col("in_group") > most).select("group", F.ceil(F.col("in_group") / most).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts"))).cast("int")
    rows = cut(narrow.join(F.broadcast(large), "group", "left").withColumn("part", part)
               .withColumn("node", F.xxhash64("group", "part")).drop("parts"), "rows")

    nodes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("group").alias("group"), F.min("links").alias("links"))
    ends = nodes.select("node", "n", F.explode(F.array_distinct(F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.col("group").alias("hash"))),
        F.transform(F.coalesce("links", F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(1).alias("kind"), x.alias("hash")))))).alias("hub")).where("hub.hash is not null")
    shared = ends.groupBy("hub").agg(F.count("*").alias("ends")).where("ends > 1").select("hub")
    edges = cut(ends.join(shared, "hub").select(F.xxhash64("hub.kind", "hub.hash").alias("hub"), "node", "n"), "edges")
    # all nodes of a group start together where its first part does
    linked = edges.groupBy("node").agg(F.lit(True).alias("linked"))
    where = cut(nodes.join(linked, "node", "left").where("linked or n > 1")
                .select("node", "n", F.pmod(F.xxhash64("group", F.lit(11)), F.lit(shards)).cast("int").alias("shard")), "start")
    quota = math.ceil(n / shards)
    for turn in range(rounds):
        tally = edges.join(where.select("node", "shard"), "node").groupBy("hub", "shard").agg(F.sum("n").alias("w"))
        best = tally.groupBy("hub").agg(F.max(F.struct("w", -F.col("shard"))).alias("b"), F.sum("w").alias("all"))
        wish = (edges.join(best, "hub").groupBy("node")
                .agg(F.max(F.struct((F.col("b.w") / F.col("all")).alias("share"), F.col("b.w").alias("w"), (-F.col("b").getField("col2")).alias("to"))).alias("b")))
        asked = where.join(wish, "node", "left").select(
            "node", "n", "shard", F.col("b.to").alias("to"),
            F.least(F.floor(F.log2(F.coalesce(F.col("b.w"), F.lit(1)) / F.col("n") + 1) * 4), F.lit(GAIN_BINS)).cast("int").alias("bin"))
        asked = cut(asked.withColumn("moves", F.coalesce(F.col("to") != F.col("shard"), F.lit(False))), f"asked{turn}")
        # shards x bins sums, whatever the number of documents
        load = {r["shard"]: r["n"] for r in asked.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        out = {r["shard"]: r["n"] for r in asked.where("moves").groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        bins = asked.where("moves").groupBy("to", "bin").agg(F.sum("n").alias("n")).collect()
        if not bins:
            break
        allowed = _shares(bins, {t: max(0, quota - load.get(t, 0)) + out.get(t, 0) // 2 for t in range(shards)})
        share = F.lit(0.0)
        for (t, b), s in allowed.items():
            share = F.when((F.col("to") == t) & (F.col("bin") == b), F.lit(s)).otherwise(share) if 0 < s < 1 else share
        full = [F.struct(F.lit(t).alias("to"), F.lit(b).alias("bin")) for (t, b), s in allowed.items() if s >= 1]
        free = F.array_contains(F.array(*full), F.struct("to", "bin")) if full else F.lit(False)
        drawn = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20) < share
        where = cut(asked.select("node", "n", F.when(F.col("moves") & (free | drawn), F.col("to")).otherwise(F.col("shard")).alias("shard")), f"round{turn}")
    return _exact(rows.join(where.select("node", "shard"), "node", "left"), n, shards)


def _shares(bins: list, room: dict[int, int]) -> dict[tuple[int, int], float]:
    """The share of each (shard, bin) that fits, larger gains first."""
    out = {}
    for r in sorted(bins, key=lambda r: (r["to"], -r["bin"])):
        fits = min(r["n"], room[r["to"]])
        room[r["to"]] -= fits
        out[r["to"], r["bin"]] = fits / r["n"]
    return out


def _exact(placed: DataFrame, n: int, shards: int) -> DataFrame:
    """Turn wished shards (null: any) into exact ones with slots; rows over a shard's share go to free slots elsewhere."""
    share = [n // shards + (t < n % shards) for t in range(shards)]
    keep = F.element_at(F.array(*map(F.lit, share)), F.col("shard") + 1)
    # rows of a node stand next to each other, so that what is over comes from few nodes
    order = [F.col("node"), F.col("doc_id"), F.col("size")]
    linked = cut(ranked(placed.where("shard is not null"), ["shard"], order, "slot", n), "linked")
    kept = linked.where(F.col("slot") < keep)
    taken = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    ends, at = [], 0
    for t in range(shards):
        at += share[t] - taken.get(t, 0)
        ends.append(at)
    rest = linked.where(F.col("slot") >= keep).drop("slot").unionByName(placed.where("shard is null")).drop("shard")
    rest = ranked(rest.withColumn("_all", F.lit(0)), ["_all"], order, "_place", n).drop("_all")
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("_place")))
    first = F.element_at(F.array(*[F.lit(e - share[t] + taken.get(t, 0)) for t, e in enumerate(ends)]), F.col("shard") + 1)
    used = F.element_at(F.array(*[F.lit(taken.get(t, 0)) for t in range(shards)]), F.col("shard") + 1)
    filled = rest.withColumn("shard", shard).withColumn("slot", F.col("_place") - first + used).drop("_place")
    return kept.unionByName(filled)
