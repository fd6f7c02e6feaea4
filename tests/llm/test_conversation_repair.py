"""Conversation repair against a search over all edit sequences and a plain dynamic program, on one and on many pieces."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessella.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        ink = INK.findall(text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, turns): the least (cost, audit) over edit sequences, found by a search in that order."""
    fault = faults(rows)
    due = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, told = heapq.heappop(heap)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows) and q in (0, 3):
            return cost, audit, told
        ahead = [(2, "I", i, after[due[q][0], q], told + ((due[q], ""),))]
        if i < len(rows):
            (role, text), cut = rows[i], fault[i] == "truncated"
            ahead.append((3, "D", i + 1, q, told))
            if fault[i] not in ("blank", "duplicate"):
                ahead.append((2 + cut, "R", i + 1, after[due[q][0], q], told + ((due[q], text),)))
                if (role[:1], q) in after:
                    ahead.append((cut, "K", i + 1, after[role[:1], q], told + ((role, text),)))
        for more, edit, j, to, kept in ahead:
            heapq.heappush(heap, (cost + more, audit + edit, j, to, kept))


def plain(rows, hurt=True):
    out = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = [r for r in (damaged(rows) if hurt else rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64], hashlib.sha256(r[3].encode()).digest()))
        turns = [r[1] for r in mine if r[1] is not None]
        told = [(r[2], r[3]) for r in mine]
        f = faults(told)
        cost, audit, kept = cheapest(told)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(f.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.select("conv_id", "gaps", *cr.COUNTS, "cost", "audit", "repaired_sha256").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def some(n, rng, conversations):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None]
    texts = ["Hi.", "No end", "  ", "", None, "Well?\n", "dots..", "é!", "tail  ", "x" * 70 + "a.", "x" * 70 + "b."]
    return [(rng.choice(conversations), rng.choice([None, *range(-2, 30)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_equals_search(spark, ranges):
    rng = random.Random(ranges)
    rows = some(250, rng, [*range(30), None, -4])
    rows += rows[:20] + [(99, None, "user", None)] * 9 + [(98, 1 << 62, "user", "A."), (98, -(1 << 61), "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    extra = df.selectExpr("*", "1 AS k", "2 AS copies", "3 AS part", "4 AS first")
    assert got(cr.repair_digests(cr.damage(extra), ranges)) == plain(rows)


def test_one_long_conversation_in_many_pieces(spark):
    rng = random.Random(3)
    rows = [(5, i, rng.choice(["user", "assistant", "assistant", "system"]), f"{rng.randrange(200)}{rng.choice(['.', ''])}") for i in range(700)]
    rows += [(5, i, "user", "again.") for i in range(300, 420)] + some(40, rng, [4, 6])
    told = [(c, t, r or " ", " " if x is None else x) for c, t, r, x in rows]
    want = plain(told, hurt=False)
    df = spark.createDataFrame(told, SCHEMA).repartition(4)
    assert got(cr.repair_digests(df, 12)) == want == got(cr.repair_digests(df, 1))
    turns = cr.repair(df, 12)[1].where("conv_id = 5").orderBy("part", "place").collect()
    assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in turns)) and "".join(r.edit for r in turns) == want[5][-2].replace("D", "")


def test_dropped_and_empty(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert got(cr.repair_digests(cr.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(cr.repair_digests(cr.damage(df.limit(0)))) == {}
