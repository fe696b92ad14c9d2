"""Repair of conversation structure: the cheapest edits that give a legal sequence of roles, found by divide and conquer.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. What came before a turn is one of four states
(nothing, system, user, assistant); an edit leads from each state to one other. Forward and backward cost vectors over these
states meet in the middle of a conversation; the crossing of least cost, and of these the one whose edits come first in ASCII
order, is chosen, and both halves are solved in the same way, in space linear in the turns (Hirschberg).

The same step works on single turns and on blocks of turns: a block of bounded size is a 4 x 4 matrix of costs. So a long
conversation is cut into blocks in parallel, blocks are multiplied up a tree, crossings go down it, and each block is then
solved by itself. No task holds more than a block or the children of a node.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import cut

#: turns of a block and children of a node of the tree, as powers of two
BLOCK_BITS, FAN_BITS = 12, 8

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: where an inserted or renamed turn leads from each state
_NEXT = (USER, USER, ASSISTANT, USER)
_LETTER = "-sua"
#: cost and letters of the inserts behind the last turn
_TAIL = ((0, ""), (6, "II"), (3, "I"), (0, ""))
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)
_COST = {"K": 0, "R": 3, "D": 4, "I": 3}
_SPACE = " \t\n\x0b\x0c\r"

#: from each state to each state: (cost, key) of the best edits, or None; keys of steps from one state are in ASCII order of the edits
Step = tuple[tuple[tuple[int, object] | None, ...], ...]


def turn_step(initial: int, fault: int) -> Step:
    """The edits of one turn: up to two inserts before it (more come back to a state passed), then D, K or R."""
    table = [[None] * 4 for _ in range(4)]
    for p in range(4):
        q, cost, inserts = p, 0, ""
        for _ in range(3):
            moves = [(q, _COST["D"], "D")]
            if fault not in (BLANK, DUPLICATE):
                more = 3 if fault == TRUNCATED else 0
                moves.append((_NEXT[q], _COST["R"] + more, "R"))
                if initial == _NEXT[q] or initial == SYSTEM and q == NOTHING:
                    moves.append((initial, more, "K"))
            for to, c, letter in moves:
                new = (cost + c, inserts + letter)
                if table[p][to] is None or new < table[p][to]:
                    table[p][to] = new
            q, cost, inserts = _NEXT[q], cost + _COST["I"], inserts + "I"
    return tuple(map(tuple, table))


@functools.cache
def symbol_step(symbol: str) -> Step:
    """The step of a turn that is written as one character: initial (nothing means another one) and fault."""
    code = ord(symbol) - ord("A")
    return turn_step(code // 4, code % 4)


Vector = list  # for each state (cost, rank of the edits in ASCII order), or None


def forward(at: Vector, steps: Sequence[Step]) -> Vector:
    """The best edits over the steps from the states in ``at``, as (cost, rank) for each state."""
    for step in steps:
        best: list = [None] * 4
        for p, here in enumerate(at):
            if here is not None:
                for q, move in enumerate(step[p]):
                    if move is not None:
                        new = (here[0] + move[0], here[1], move[1])
                        if best[q] is None or new < best[q]:
                            best[q] = new
        order = sorted((b[1:], q) for q, b in enumerate(best) if b is not None)
        at = [None] * 4
        for rank, (_, q) in enumerate(order):
            at[q] = (best[q][0], rank)
    return at


def backward(cost: list, steps: Sequence[Step]) -> list:
    """The least cost over the steps from each state to the ends of the given costs."""
    for step in reversed(steps):
        cost = [min((m[0] + c for m, c in zip(row, cost, strict=True) if m is not None and c is not None), default=None) for row in step]
    return cost


def _from(state: int) -> Vector:
    return [(0, 0) if q == state else None for q in range(4)]


def summary(steps: Sequence[Step]) -> Step:
    """The steps as one step: costs and, as keys, ranks."""
    return tuple(tuple(forward(_from(p), steps)) for p in range(4))


def last_state(steps: Sequence[Step], entry: int) -> int:
    """The state in which the best edits end, with the inserts that are needed behind them."""
    ends = forward(_from(entry), steps)
    return min((e[0] + _TAIL[q][0], e[1], q) for q, e in enumerate(ends) if e is not None)[2]


def crossings(steps: Sequence[Step], entry: int, exit_: int) -> list[int]:
    """The state after each step on the cheapest way from entry to exit, of these the one whose edits come first."""
    if len(steps) == 1:
        return [exit_]
    mid = len(steps) // 2
    ahead = forward(_from(entry), steps[:mid])
    behind = backward([0 if q == exit_ else None for q in range(4)], steps[mid:])
    state = min((a[0] + b, a[1], q) for q, (a, b) in enumerate(zip(ahead, behind, strict=True)) if a is not None and b is not None)[2]
    return crossings(steps[:mid], entry, state) + crossings(steps[mid:], state, exit_)


@functools.lru_cache(1 << 16)
def block_edits(symbols: str, entry: int, exit_: int | None) -> tuple[list[str], list[str]]:
    """For each turn its edits and the initials of the roles that they leave ("-" for a deletion).

    Without an exit state the block ends its conversation, and inserts that are needed behind it go to its last turn.
    """
    steps = [symbol_step(s) for s in symbols]
    last = exit_ is None
    exit_ = last_state(steps, entry) if last else exit_
    edits, roles, p = [], [], entry
    for step, q in zip(steps, crossings(steps, entry, exit_), strict=True):
        letters, left, at = step[p][q][1], "", p
        for x in letters:
            at = at if x == "D" else SYSTEM if x == "K" and q == SYSTEM else _NEXT[at]
            left += "-" if x == "D" else _LETTER[at]
        edits.append(letters)
        roles.append(left)
        p = q
    if last:
        for x in _TAIL[p][1]:
            p = _NEXT[p]
            edits[-1] += x
            roles[-1] += _LETTER[p]
    return edits, roles


def _steps(rows: list[list[int | None]]) -> list[Step]:
    """Steps from lists of 16 costs and 16 ranks (-1: no way)."""
    return [tuple(tuple(None if m[4 * p + q] < 0 else (m[4 * p + q], m[16 + 4 * p + q]) for q in range(4)) for p in range(4)) for m in rows]


def _numbers(step: Step) -> list[int]:
    flat = [x or (-1, -1) for row in step for x in row]
    return [x[0] for x in flat] + [x[1] for x in flat]


def _map(df: DataFrame, fn, schema: str) -> DataFrame:
    """Rows of df as dictionaries through fn, which gives one tuple for each."""
    names = re.findall(r"(?:^|, )(\w+) ", re.sub(r"<.*?>+", "", schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(r) for r in batch.drop_columns(["conv_id"]).to_pylist()]
            made = pa.RecordBatch.from_pylist([dict(zip(names[1:], r, strict=True)) for r in rows]) if rows else None
            if made is not None:
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *[made.column(n) for n in names[1:]]], names)
    return df.mapInArrow(run, schema)


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which a null key meets a null key."""
    other = right.select(*[F.col(k).alias(f"{k}_") if k in keys else F.col(k) for k in right.columns])
    return left.join(other, functools.reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"{k}_"]) for k in keys]), how).drop(*[f"{k}_" for k in keys])


def _node_entries(nodes: DataFrame, kind: str, fan_bits: int) -> DataFrame:
    """conv_id, block, entry, exit (null for the last): the states around each block of conversations with several blocks.

    nodes: conv_id, block, m. Groups of at most 2**fan_bits nodes become one; this goes on until every conversation has
    no more than that. The crossings between its nodes are found there, then within each node, down to the blocks.
    """
    fan = 1 << fan_bits
    levels = [nodes]
    grouped = lambda df, key: df.groupBy("conv_id", key.alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "m"))).alias("below"))
    while (levels[-1].groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0) > fan:
        up = grouped(levels[-1], F.shiftright("block", fan_bits))
        fold = lambda r: (r["up"], _numbers(summary(_steps([x["m"] for x in r["below"]]))))
        levels.append(cut(_map(up, fold, f"conv_id {kind}, block long, m array<long>"), f"level{len(levels)}"))

    def part(r: dict) -> tuple:
        steps, entry = _steps([x["m"] for x in r["below"]]), r["entry"]
        states = crossings(steps, entry, last_state(steps, entry) if r["exit"] is None else r["exit"])
        own = [{"block": x["block"], "entry": p, "exit": q} for x, p, q in zip(r["below"], [entry, *states[:-1]], states, strict=True)]
        if r["exit"] is None:
            own[-1]["exit"] = -1
        return (own,)

    found = None
    for level in reversed(levels):
        if found is None:
            groups = grouped(level, F.lit(0)).withColumns({"entry": F.lit(NOTHING), "exit": F.lit(None).cast("int")})
        else:
            states = found.select("conv_id", F.col("block").alias("up"), "entry", "exit")
            groups = _joined(grouped(level, F.shiftright("block", fan_bits)), states, ["conv_id", "up"], "inner")
        rows = _map(groups, part, f"conv_id {kind}, own array<struct<block: long, entry: long, exit: long>>")
        found = cut(rows.select("conv_id", F.explode("own").alias("o")).select("conv_id", "o.block", "o.entry", F.when(F.col("o.exit") >= 0, F.col("o.exit")).alias("exit")), "states")
    return found


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NOTHING)


def repair_edits(turns: DataFrame, block_bits: int = BLOCK_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """The edits that repair conversations: conv_id, pos, nth, edit, role, text, turn, initial and fault, a row for each edit.

    turns needs conv_id, turn, role and text; other columns are not read. Turns of a conversation are taken by turn (nulls
    first), equal ones by role, then in an order that depends on the text only. Null roles and texts count as one space; a
    null conv_id is a conversation. edit is K (keep), R (new role), D (delete) or I (insert); role and text are those after the edit
    (null for D); turn, initial (code of the role's initial) and fault (code) are those of the turn before it, null for I.
    Edits of a conversation are in order of (pos, nth). Repeated rows are duplicates of the first. An empty table gives none.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = cut(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), F.monotonically_increasing_id().alias("id")), "turns")
    body = F.rtrim("text", F.lit(_SPACE))
    light = rows.select("conv_id", "turn", "id", "role", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("key"), _initial(F.col("role")).alias("initial"),
                        F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(CLEAN).alias("own_fault"))
    order = ["conv_id", "turn", "role", "key", "id"]
    placed = cut(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("role"), "order")
    repeated = placed.groupBy("conv_id", "key").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when(F.col("own_fault") == BLANK, BLANK).when(F.col("pos") > F.col("first"), DUPLICATE).otherwise(F.col("own_fault"))
    marked = _joined(placed, repeated, ["conv_id", "key"], "left").select("conv_id", "turn", "id", "pos", "initial", fault.alias("fault"))
    turn = F.struct("pos", "id", "turn", "initial", "fault")
    blocks = cut(marked.groupBy("conv_id", F.shiftright("pos", block_bits).alias("block")).agg(F.array_sort(F.collect_list(turn)).alias("turns")).withColumn(
        "symbols", F.array_join(F.transform("turns", lambda t: F.char(t["initial"] * 4 + t["fault"] + ord("A"))), "")), "blocks")
    several = blocks.groupBy("conv_id").count().where("count > 1").drop("count")
    parts = _joined(blocks.select("conv_id", "block", "symbols"), several, ["conv_id"], "left_semi")
    nodes = cut(_map(parts, lambda r: (r["block"], _numbers(summary([symbol_step(s) for s in r["symbols"]]))), f"conv_id {kind}, block long, m array<long>"), "nodes")
    around = _joined(blocks.select("conv_id", "block", "symbols"), _node_entries(nodes, kind, fan_bits), ["conv_id", "block"], "left")

    def solve(r: dict) -> tuple:
        return (r["block"], *block_edits(r["symbols"], NOTHING if r["entry"] is None else r["entry"], r["exit"]))

    solved = _map(around, solve, f"conv_id {kind}, block long, edits array<string>, roles array<string>")
    each = _joined(blocks.select("conv_id", "block", "turns"), solved, ["conv_id", "block"], "inner").select(F.explode(F.arrays_zip("turns", "edits", "roles")).alias("z"))
    edits = each.select("z.turns.*", F.col("z.edits").alias("edits"), F.col("z.roles").alias("roles"))
    whole = edits.drop("turn").join(rows, "id")
    letter = F.substring("roles", F.col("nth") + 1, F.lit(1))
    own = F.col("edit") != "I"
    named = F.when(letter == "u", "user").otherwise("assistant")
    return (whole.select("conv_id", "pos", "turn", "initial", "fault", "role", "text", "roles", F.posexplode(F.split("edits", "")).alias("nth", "edit"))
            .where("edit != ''")
            .select("conv_id", "pos", "nth", "edit", F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", named).alias("role"),
                    F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", "").alias("text"),
                    *[F.when(own, F.col(c)).alias(c) for c in ("turn", "initial", "fault")]))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


class _Digest:
    """What is known of a conversation after some of its edits, in order."""

    def __init__(self):
        self.sha, self.audit, self.lines = hashlib.sha256(), [], 0
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, edit: str, role: str | None, text: str | None, turn: int | None, initial: int | None, fault: int | None) -> None:
        self.audit.append(edit)
        self.cost += _COST[edit] + (3 if edit in "KR" and fault == TRUNCATED else 0)
        if edit != "D":
            self.sha.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1
        if edit != "I":
            self.faults[fault] += 1
            self.illegal += self.before is not None and (self.before, initial) not in _LEGAL
            self.before = initial
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1

    def row(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return dict(zip(_COUNTS, [gaps, *self.faults[1:], self.illegal, self.cost], strict=True)) | {"audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def digests(edits: DataFrame, every: DataFrame) -> DataFrame:
    """conv_id, counts, cost, audit and hash of the repaired conversation for each conv_id in ``every`` (a DataFrame of conv_id).

    The hash runs over a conversation in order, so one task reads all of it, as a sorted stream and never as one row.
    Conversations without edits have zeros, an empty audit and the hash of the empty string.
    """
    kind = every.schema["conv_id"].dataType.simpleString()
    stream = edits.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in rows], pa.int64()) for c in _COUNTS] + [pa.array([r[c] for r in rows], pa.string()) for c in ("audit", "repaired_sha256")]
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), *cols], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        now, digest, kind = None, None, None
        for batch in batches:
            kind, ids, rows = batch.schema.field("conv_id").type, [], []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text", "turn", "initial", "fault")]
            for conv, *edit in zip(*columns, strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        ids.append(now)
                        rows.append(digest.row())
                    now, digest = conv, _Digest()
                digest.add(*edit)
            if ids:
                yield out(ids, rows, kind)
        if digest is not None:
            yield out([now], [digest.row()], kind)

    schema = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
    known = stream.mapInArrow(run, schema)
    zero = {c: F.coalesce(c, F.lit(0)) for c in _COUNTS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))}
    return _joined(every.select("conv_id").distinct(), known, ["conv_id"], "left").withColumns(zero).select("conv_id", *_COUNTS, "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of "conv_id:turn" deals out (nulls: one space)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    dealt = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), kind.alias("kind")).where("kind != 0")
    return dealt.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
