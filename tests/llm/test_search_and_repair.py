"""Ranked search against plain scoring of every document, and repairs against plain dynamic programming on whole strings."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from invented import WORDS, prose

from fieldloom.llm import dialogue, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            s = 0
            for t in set(terms(text)) & set(c):
                m = 100 - 50 + 50 * c.total() * n_docs // n_terms
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if z else d, -s) for k, (s, z, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("window, short", [(8, 4), (4096, 64), (16, 10**9), (16, 1)])
def test_search_equals_scoring_of_every_document(spark, monkeypatch, window, short):
    monkeypatch.setattr(lexical, "WINDOW_DOCS", window)
    monkeypatch.setattr(lexical, "SHORT_SHARE", short)
    monkeypatch.setattr(lexical, "SHARD_DOCS", 50)
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice(WORDS[: 4 + i % 30]) for _ in range(rng.randint(1, 60)))) for i in range(400)]
    docs += [(None, "alpha gamma."), (400, None), (401, ""), (402, docs[3][1]), (3, docs[3][1]), (403, "ΑΛΦΑ alpha-BETA—x y 中文")]
    items = [(k, " ".join(rng.sample(WORDS, rng.randint(1, 12)))) for k in range(12)] + [(50, None), (51, "--"), (None, "Alpha"), (52, "中文 beta"), (52, "gamma"), (53, "unknown")]
    got = lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, items[0]], "item_id long, text string"), 7)
    assert sorted(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == plain_search(docs, items, 7)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 10)
    docs = [(i, prose(i, 30)) for i in range(100)]
    items = [(k, prose(k + 500, 6)) for k in range(9)]
    got = lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items, 5)


def test_search_without_rows(spark, odd_docs, empty_docs):
    items = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    assert lexical.top_documents(empty_docs, items).count() == 0
    assert lexical.top_documents(odd_docs, items.where("false")).count() == 0
    out = lexical.top_documents(odd_docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() > 3


NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(turns):
    """Least (cost, edits) for each state after each turn, as whole strings."""
    best, seen, faults = {"": (0, "")}, set(), []
    for role, text in turns:
        body = text.rstrip(dialogue._SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        after = {}

        def put(state, cost, edits, after=after):
            after[state] = min(after.get(state, (10**9, "")), (cost, edits))

        for state, (cost, edits) in best.items():
            for _ in range(4):
                put(state, cost + 4, edits + "D")
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    put(NEXT[state], cost + 3 + more, edits + "R")
                    if role[:1] == NEXT[state] or role[:1] == "s" and state == "":
                        put(role[:1], cost + more, edits + "K")
                state, cost, edits = NEXT[state], cost + 3, edits + "I"
        best = after
    ends = [(best[s][0] + c, best[s][1] + t) for s, c, t in (("", 0, ""), ("s", 6, "II"), ("u", 3, "I"), ("a", 0, "")) if s in best]
    cost, audit = min(ends)
    lines, at, left = [], 0, audit.replace("D", "")
    for e in audit:
        if e != "D":
            k = len(lines) + len(left) % 2
            role = "user" if k % 2 == 0 else "assistant"
            lines.append(f"{turns[at][0]}:{turns[at][1]}" if e == "K" else f"{role}:{'' if e == 'I' else turns[at][1]}")
        at += e != "I"
    legal = {"su", "ua", "au"}
    illegal = sum(a[0][:1] + b[0][:1] not in legal for a, b in zip(turns, turns[1:]))
    return (*[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("block_bits, fan_bits", [(1, 1), (2, 3), (12, 8)])
def test_repair_equals_plain_dynamic_programming(spark, block_bits, fan_bits):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "cut off", "", " \n", "What?", "One more.  ", "x"]
    convs = {}
    for c in range(60):
        convs[c] = [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice(texts) + rng.choice(["", str(k)]) + rng.choice(["", ".", ""])) for k in range(rng.randint(1, 40))]
    convs[60] = [("user" if k % 3 else "assistant", f"t{k}.") for k in range(300)]
    rows = [(c, t, role, text, "x") for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, pos string").repartition(3)
    out = dialogue.digests(dialogue.repair_edits(df, block_bits, fan_bits), df).collect()
    got = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in out}
    assert got == {c: plain_repair(turns) for c, turns in convs.items()}
    assert all(r.gaps == 0 for r in out)


def test_crossings_of_blocks_are_those_of_turns():
    rng = random.Random(9)
    for _ in range(200):
        symbols = "".join(chr(ord("A") + rng.randrange(16)) for _ in range(rng.randint(2, 30)))
        steps = [dialogue.symbol_step(s) for s in symbols]
        k = rng.randint(1, len(steps) - 1)
        whole = dialogue.summary(steps)
        assert dialogue.summary([dialogue.summary(steps[:k]), dialogue.summary(steps[k:])]) == whole
        exit_ = dialogue.last_state(steps, 0)
        inner = dialogue.crossings([dialogue.summary(steps[:k]), dialogue.summary(steps[k:])], 0, exit_)
        assert inner == [dialogue.crossings(steps, 0, exit_)[k - 1], exit_]


def test_odd_conversations(spark):
    rows = [(1, None, None, None), (1, 2, "user", "Hi."), (1, 5, "assistant", "Yes."), (None, 0, "user", "Hi."), (None, 0, "user", "Hi."), (2, None, "system", "Be kind."),
            (3, 1, "user", "x" * 2_000_000 + "."), (3, 2, "assistant", "." * 300_000 + " " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in dialogue.digests(dialogue.repair_edits(df), df.unionByName(spark.createDataFrame([(9, 1, "user", "gone")], df.schema))).collect()}
    assert (got[1].blank, got[1].gaps, got[1].audit, got[1].illegal) == (1, 2, "DKK", 1)
    assert (got[None].duplicate, got[None].audit, got[None].cost, got[None].gaps) == (1, "KDI", 7, 0)
    assert (got[2].audit, got[2].cost) == ("D", 4)
    assert (got[3].audit, got[3].cost) == ("KK", 0)
    assert (got[9].audit, got[9].cost, got[9].repaired_sha256) == ("", 0, hashlib.sha256(b"").hexdigest())
    assert dialogue.digests(dialogue.repair_edits(df.where("false")), df.where("false")).count() == 0
    assert dialogue.damaged(df).count() <= 2 * len(rows)


def test_damage_follows_the_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", f"Text {t}. Why? No!") for c in range(20) for t in range(10)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = ("" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text), ("user" if k == 4 else role)
        want += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(tuple, dialogue.damaged(df).collect()), key=str) == sorted(want, key=str)
