"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source has the same wanted number of copies, target / source size. Its whole part is taken at once;
the fraction left is a probability, and these are rounded together: two units meet, one gives the other as many words as
are needed for one of them to become 0 or 1, the direction drawn so that expectations hold, and the other goes on. So the
words of a source stay at the target at every step. The work is a reduction tree: units meet in blocks of at most
BLOCK rows, each block hands one unit on, and the next level treats those in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import WORD, cut

CYCLE = (1, 2, 3)
CAP = 3
BLOCK = 32
LAST = 256
BUCKET_ROWS = 2048


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """source, n, source_size, weight, target (double), wanted (copies of each document) for each source.

    Sources by code point, null last, take the weights in turn and share all words; a target stops at cap times its
    source's size and what is over goes to the others by weight, until none is above. The window is over one row for
    each source; the words themselves are summed before it. Sources without words get 0.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    per = cut(per.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), turn + 1).cast("long")), "sources")
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("source_size") * cap
        got = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, 1).otherwise(0)).alias("n_full"),
                      F.sum(F.when(full, F.col("source_size") * cap).otherwise(0)).alias("taken"),
                      F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if level == 0.0 and got["all"] is not None:
            # the first level comes from all sources: none is full yet
            total = per.agg(F.sum("weight")).first()[0]
            level = got["all"] / total
            if not got["all"]:
                break
            continue
        if got["all"] is None or got["n_full"] == before or not got["weight"]:
            break
        before = got["n_full"]
        level = (got["all"] - got["taken"]) / got["weight"]
    full = F.col("weight") * F.lit(level) >= F.col("source_size") * cap
    target = F.when(full, (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.lit(level))
    wanted = F.when(F.col("source_size") == 0, 0.0).when(full, float(cap)).otherwise(F.least(target / F.col("source_size"), F.lit(float(cap))))
    return per.select("source", "n", "source_size", "weight", target.alias("target"), wanted.alias("wanted"))


def _draw(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def _block_rounding(units: Column, seed: Column) -> Column:
    """Let the units of a block meet one after the other: struct(carry, done)."""

    def meet(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        c_room, c_mass = (1 - c["p"]) * c["size"], c["p"] * c["size"]
        x_room, x_mass = (1 - x["p"]) * x["size"], x["p"] * x["size"]
        up, down = F.least(c_room, x_mass), F.least(c_mass, x_room)
        rise = _draw(seed, c["key"], x["key"], c["p"], x["p"]) * (up + down) < down
        c_ends = F.when(rise, c_room <= x_mass).otherwise(c_mass <= x_room)
        moved = F.when(rise, up).otherwise(-down)
        near = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
        c_next = c.withField("p", F.when(c_ends, F.when(rise, 1.0).otherwise(0.0)).otherwise(near(c["p"] + moved / c["size"])))
        x_next = x.withField("p", F.when(c_ends, near(x["p"] - moved / x["size"])).otherwise(F.when(rise, 0.0).otherwise(1.0)))
        return F.struct(F.when(c_ends, x_next).otherwise(c_next).alias("carry"),
                        F.concat(acc["done"], F.array(F.when(c_ends, c_next).otherwise(x_next))).alias("done"))

    start = F.struct(units[0].alias("carry"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, F.lit(2), F.size(units)), start, meet)


def _settled(r: Column) -> Column:
    """All units of a source's last block, rounded."""
    c = r["carry"]
    end = F.when(c["p"] >= 0.5, 1.0).otherwise(0.0)
    over = (end - c["p"]) * c["size"]
    gain = lambda d: F.abs(over + F.when(d["p"] > 0.5, -d["size"]).otherwise(d["size"]))
    best = F.array_min(F.transform(r["done"], lambda d, i: F.struct(gain(d).alias("e"), i.alias("i"))))
    turned = F.transform(r["done"], lambda d, i: F.when((i == best["i"]) & (best["e"] < F.abs(over)), d.withField("p", 1 - d["p"])).otherwise(d))
    return F.concat(turned, F.array(c.withField("p", end)))


def pivotal_rounding(units: DataFrame, seed: int = 17) -> DataFrame:
    """Round the column p of units (source, key, size, p) to 0.0 or 1.0, keeping the sum of p * size of each source.

    Units without size or fraction come back as they are. Reruns agree, as draws are hashes of the units; equal rows
    count as often as they come.
    """
    fraction = (F.col("size") > 0) & (F.col("p") > 0) & (F.col("p") < 1)
    done, level = [units.where(~fraction)], 0
    rest = units.where(fraction)
    while (counts := cut(rest.groupBy("source").agg(F.count("*").alias("n")), f"counts{level}")).take(1):
        # one row for each source: Spark sends this side to all tasks where its size allows
        counted = rest.join(counts, rest["source"].eqNullSafe(counts["source"])).drop(counts["source"])
        dealt = counted.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed + level)), F.ceil(F.col("n") / BUCKET_ROWS)).cast("int"))
        w = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("key", F.lit(seed - 1 - level)), "key", "size", "p")
        block = F.when(F.col("n") <= LAST, 0).otherwise(F.floor((F.row_number().over(w) - 1) / BLOCK)).cast("int")
        met = (dealt.withColumn("block", block).groupBy("source", "bucket", "block", "n")
               .agg(F.collect_list(F.struct("size", "key", "p")).alias("units"))
               .select("source", "n", _block_rounding(F.sort_array("units", asc=False), F.lit(seed * 1000 + level)).alias("r")))
        tagged = lambda units, on: F.transform(units, lambda u: F.struct(F.lit(on).alias("goes_on"), u.alias("u")))
        rows = F.when(F.col("n") <= LAST, tagged(_settled(F.col("r")), False)).otherwise(
            F.concat(tagged(F.array("r.carry"), True), tagged(F.col("r.done"), False)))
        table = cut(met.select("source", F.explode(rows).alias("x")).select(
            "source", "x.u.key", "x.u.size", "x.u.p", "x.goes_on"), f"level{level}")
        done.append(table.where(~F.col("goes_on")))
        rest = table.where("goes_on").drop("goes_on")
        level += 1
    out = done[0].select("source", "key", "size", "p")
    for part in done[1:]:
        out = out.unionByName(part.select("source", "key", "size", "p"))
    return out


def mixed(narrow: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP, seed: int = 17) -> DataFrame:
    """Copies of each row of narrow (source, key, size): source, key, size, source_size, target, copies.

    ``key`` identifies a document (any type; null is a value); rows with equal keys are rounded one by one. A document
    without words is never taken. An empty table gives an empty result.
    """
    narrow = cut(narrow.select("source", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "sizes")
    targets = source_targets(narrow, cycle, cap)

    def with_target(df: DataFrame) -> DataFrame:
        # one row for each source: Spark sends this side to all tasks where its size allows
        return df.join(targets, df["source"].eqNullSafe(targets["source"])).drop(targets["source"])

    units = with_target(narrow).select("source", "key", "size", (F.col("wanted") - F.floor("wanted")).alias("p"))
    copies = F.when(F.col("size") <= 0, 0).otherwise(F.floor("wanted") + F.round(F.col("p"))).cast("int")
    return with_target(pivotal_rounding(cut(units, "units"), seed)).select(
        "source", "key", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP, seed: int = 17) -> DataFrame:
    """The mixture itself: each row of docs as often as the mix takes it (rows with 0 copies go), all columns kept.

    Repeated rows share their copies evenly. Null text, null source and null doc_id are values like others.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("source", "text").alias("h"), F.length("text").alias("n"))
    plan = mixed(docs.select("source", key.alias("key"), n_words(F.col("text")).alias("size")), cycle, cap, seed)
    rows = plan.groupBy(F.to_json("key").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    # whole rows travel as one struct, so that no column name can clash
    packed = docs.select(F.struct("*").alias("doc"), F.to_json(key).alias("key")).join(rows, "key")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key")) - 1
    each = F.floor(F.col("copies") / F.col("rows")) + F.when(nth < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return (packed.withColumn("each", each.cast("int")).where("each > 0")
            .select("doc", F.explode(F.sequence(F.lit(1), F.col("each")))).select("doc.*"))
