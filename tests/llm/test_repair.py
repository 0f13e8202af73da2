"""Block tables and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from equiwatch.llm import blocks as B
from equiwatch.llm import repair as R
from equiwatch.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, kind string, present string, audit int"
LEGAL_END = re.compile(r"(s?(ua)+)?\Z")


def enumerated(symbols):
    """(cost, initials) by trying every sequence of edits."""
    best = None

    def go(i, state, cost, text, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(symbols) and state in B.ENDS:
            best = min(best or (cost, text), (cost, text))
        if inserts < 3:
            go(i, B.THEN[state], cost + 5, text + "I", inserts + 1)
        if i < len(symbols):
            for name, c, to in B.edges(state, symbols[i]):
                go(i + 1, to, cost + c, text + name, 0)

    go(0, B.NOTHING, 0, "", 0)
    return best


def stepwise(messages):
    """(cost, initials) of (initial, cut short, must go) rows, a message at a time, states as written text's last initial."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(costs):
        todo = list(costs)
        while todo:
            q = todo.pop()
            to = "a" if q == "u" else "u"
            new = (costs[q][0] + 5, costs[q][1] + "I")
            if to not in costs or new < costs[to]:
                costs[to] = new
                todo.append(to)
        return costs

    costs = inserted({"": (0, "")})
    for initial, cut, gone in messages:
        new = {}

        def offer(q, value):
            if q not in new or value < new[q]:
                new[q] = value

        for q, (c, text) in costs.items():
            offer(q, (c + 2, text + "D"))
            if not gone:
                for to in after[q].values():
                    if to in "ua":
                        offer(to, (c + 1 + 5 * cut, text + "R"))
                if initial in after[q]:
                    offer(after[q][initial], (c + 5 * cut, text + "K"))
        costs = inserted(new)
    return min(costs[q] for q in ("", "a") if q in costs)


@pytest.mark.parametrize("n", range(4))
def test_every_short_sequence(n):
    t = B.BlockTable()
    assert all(t.cheapest_edits(bytes(s)) == enumerated(s) for s in itertools.product(range(B.SYMBOLS), repeat=n))


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_blocks_of_any_length_agree_with_single_steps(block):
    t, rng = B.BlockTable(block), random.Random(block)
    for _ in range(300):
        rows = [(rng.choice("suauauax"), rng.random() < 0.2, rng.random() < 0.1) for _ in range(rng.randint(0, 50))]
        assert t.cheapest_edits(bytes(B.symbol(*r) for r in rows)) == stepwise(rows)


def test_tables_stay_small():
    t = B.BlockTable()
    assert len(t.vectors) < 500
    assert max(x for v in t.vectors for x in v if x < B.NEVER) <= B.LIMIT


def brute(rows):
    """The contract's columns from rows (conv, turn, role, text), already damaged; None rows name a conversation only."""
    out = {}
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: repr(r[0])), key=lambda r: r[0]):
        own = [r for r in own if len(r) > 1]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = [r[1] for r in own if r[1] is not None]
        faults, messages, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, _, role, text in own:
            kind = None
            if not re.search(r"[^\x20\x09-\x0D]", text):
                kind = "blank"
            elif (role, text) in seen:
                kind = "duplicate"
            elif text.rstrip(" \t\n\v\f\r")[-1] not in ".!?":
                kind = "truncated"
            seen.add((role, text))
            if kind:
                faults[kind] += 1
            messages.append((role[:1], kind == "truncated", kind in ("blank", "duplicate")))
        cost, audit = stepwise(messages)
        written, at = [], 0
        for name in audit:
            last = written[-1][0][:1] if written else ""
            if name == "I":
                written.append(("assistant" if last == "u" else "user", ""))
                continue
            role, text = own[at][2:]
            at += 1
            if name == "K":
                written.append((role, text))
            elif name == "R":
                written.append(("assistant" if last == "u" else "user", text))
        assert LEGAL_END.match("".join(r[:1] for r, _ in written))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(messages))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in written).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            out.append((conv,))
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def answer(audits, digests):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    empty = hashlib.sha256(b"").hexdigest()
    known = {r["conv_id"]: r["repaired_sha256"] for r in digests.collect()}
    return {r["conv_id"]: (*(r[c] for c in names), known.get(r["conv_id"], empty)) for r in audits.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    got = [r.asDict() for r in QUERIES["op12_repair"](spark, path).collect()]
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in got} == brute(damaged(rows))
    assert len(got) == len({r[0] for r in rows})


def odd_rows():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None, "admin", "É"]
    texts = ["Yes.", "No", "", None, " \t\n", "Is it?  \n", "…", "a.b", "漢字。", "x\x00.", "Yes."]
    rows = [(c, t, rng.choice(roles[:3] * 3 + roles), rng.choice(texts)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(None, t, "user", "Hi.") for t in (None, 3, 9)]
    rows += [(50, None, "user", "Same."), (50, 2, "user", "Same."), (50, 7, "assistant", "End.")]
    rows += [(51, None, "assistant", "a."), (52, 4, "user", "w. " * 50000)]
    return rows


def test_odd_rows_and_clashing_columns(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "k", "p", 1) for r in rows], SCHEMA)
    audits, edits = R.repair_conversations(df)
    spaced = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in rows]
    assert answer(audits, R.repaired_digests(edits)) == brute(spaced)


def test_repeated_rows_and_equal_turns(spark):
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")]
    audits, edits = R.repair_conversations(spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA))
    assert answer(audits, R.repaired_digests(edits)) == brute(rows)
    assert [(r["edit"], r["role"], r["text"]) for r in edits.orderBy("position").collect()] == [
        ("K", "user", "Hi."), ("D", "user", "Hi."), ("D", "user", "Hi."), ("K", "assistant", "Yes.")]


def test_long_conversation_over_several_batches(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"text {rng.randrange(900)}.")
            for t in range(25000)] + [(8, 0, "user", "Hi.")]
    audits, edits = R.repair_conversations(spark.createDataFrame([(*r, "", "", 0) for r in rows], SCHEMA))
    assert answer(audits, R.repaired_digests(edits)) == brute(rows)


def test_absent_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.", "", "", 0), (2, 1, "user", "Hi.", "", "", 0)], SCHEMA)
    audits, edits = R.repair_conversations(df, present=F.col("conv_id") == 2)
    got = answer(audits, R.repaired_digests(edits))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[2][5:7] == (2, "D")
    audits, edits = R.repair_conversations(df.limit(0))
    assert audits.collect() == [] and edits.collect() == []
    assert R.repaired_digests(edits).collect() == []
