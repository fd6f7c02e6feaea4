"""Conversation structure repair: the cheapest edits that give each conversation the shape (s?(ua)+)? of role initials.

A turn is kept (0), given the role that is due (2), or deleted (3); a blank turn or one whose role and text came before must
be deleted, one that ends without [.!?] costs 1 more unless it is deleted; an empty turn of the role that is due may be put in
anywhere (2). Over turn and grammar state (0 nothing yet, 1 after system, 2 after user, 3 after assistant) a backward pass
holds the cost to go; a forward pass takes, of the edits that keep to it, the one least in ASCII (D, I, K, R).

A conversation may hold a third of all rows, so none is one task's:

* Turns travel as lines: keys, digest and flags, without the text; equal lines are counted before they are sent. Lines are
  dealt by ranges of (conversation, turn, role, text); a *piece* is what one task holds of a conversation.
* Only the first and last piece of a task can be part of a longer conversation. Such a piece hands on the cheapest cost
  from each state before it to each state after it (4 x 4). The pieces of a conversation, at most one a task, are chained
  backward by these; then each is walked from its four states and the walks are chained forward.
* Texts join the decisions by their key, which no two decisions share. `hashed` reads a conversation's turns in
  order as a stream, one batch at a time, as a SHA-256 has to be taken in order.

Null roles and texts are one space; null turns come first; turns of the same number go by role, then by the text's first 64
characters, then by its SHA-256; rows of a null conv_id are one conversation. Rows with copies = 0 only name their
conversation; one without any others gets zeros, an empty audit and no turns. An empty table gives no rows. Roles are
known by their first character, in lower case only; others can be given a role or deleted. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

SPACES = " \t\n\x0b\x0c\r"
KEY = ["k", "has_turn", "n_turn", "role", "head", "digest"]
NEXT = (2, 2, 3, 2)  # the state that a turn of the role due leads to
OWN = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
TERMINAL, TAIL = (0.0, 4.0, 2.0, 0.0), ("", "II", "I", "")
INF = float("inf")
LEGAL = {"su", "ua", "au"}
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): by crc32 of `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 takes
    its [.!?], 3 repeats it, 4 makes its role user."""
    c = conversations
    text_of = lambda x: F.coalesce(c[x].cast("string"), F.lit(" "))
    what = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = F.when(what == 1, "").when(what == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    return c.select("conv_id", "turn", F.when(what == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), F.when(what == 0, 0).when(what == 3, 2).otherwise(1).alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """KEY without nulls (k is '' for a null conv_id, else '=' and its text), text, copies."""
    text = F.coalesce(rows["text"], F.lit(" "))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), rows["conv_id"].cast("string")), F.lit("")).alias("k"),
        rows["turn"].isNotNull().alias("has_turn"),
        F.coalesce(rows["turn"].cast("long"), F.lit(0)).alias("n_turn"),
        F.coalesce(rows["role"], F.lit(" ")).alias("role"),
        F.substring(text, 1, 64).alias("head"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text.alias("text"),
        (rows["copies"].cast("long") if "copies" in rows.columns else F.lit(1).cast("long")).alias("copies"),
    )


def _lines(keyed: DataFrame) -> DataFrame:
    """KEY, copies, blank, cut, first: every different turn of a conversation once, and whether its role and text come there first."""
    ink = F.rtrim("text", F.lit(SPACES))
    there = F.col("copies") > 0
    bare = {"has_turn": F.lit(False), "n_turn": F.lit(0).cast("long"), "role": F.lit(""), "head": F.lit(""), "digest": F.lit(b"")}
    lines = keyed.select("k", *[F.when(there, F.col(x)).otherwise(bare[x]).alias(x) for x in KEY[1:]], "copies", (ink == "").alias("blank"), (~F.right(ink, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    lines = lines.groupBy(*KEY).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    firsts = lines.where("copies > 0").groupBy("k", "role", "head", "digest").agg(F.min(F.struct("has_turn", "n_turn")).alias("at"))
    firsts = firsts.select("k", F.col("at.has_turn").alias("has_turn"), F.col("at.n_turn").alias("n_turn"), "role", "head", "digest", F.lit(True).alias("first"))
    return lines.join(firsts, KEY, "left").withColumn("first", F.coalesce("first", F.lit(False)))


def closed(v) -> tuple:
    """Costs by state, where turns may be put in first."""
    user = min(v[2], 2 + v[3])
    return min(v[0], 2 + user), min(v[1], 2 + user), user, min(v[3], 2 + v[2])


@functools.cache
def step(kind: str, after: tuple) -> tuple:
    """(costs before a turn less their minimum, that minimum, per state the edits through the turn and the state they lead to)."""
    cut, own = kind.isupper(), OWN.get(kind.lower(), (None,) * 4)
    ways = []
    for q in range(4):
        ways.append([("D", 3 + after[q], q)])
        if kind != "x":
            if own[q] is not None:
                ways[q].append(("K", cut + after[own[q]], own[q]))
            ways[q].append(("R", 2 + cut + after[NEXT[q]], NEXT[q]))
    before = closed([min(cost for _, cost, _ in w) for w in ways])

    def walk(q: int) -> tuple[str, int]:
        edits = ""
        while True:
            tight = [(e, to) for e, cost, to in ways[q] if cost == before[q]]
            if tight[:1] != [("D", q)] and 2 + before[NEXT[q]] == before[q]:
                edits, q = edits + "I", NEXT[q]
            else:
                return edits + tight[0][0], tight[0][1]

    low = min(before)
    return tuple(x - low for x in before), low, [walk(q) for q in range(4)]


def backward(kinds: list[tuple[str, int]], end: tuple) -> tuple[tuple, list]:
    """The costs to go before the first of the (kind, repeats), and the walks of each."""
    v, low, walks = end, 0.0, []
    for kind, n in reversed(kinds):
        if kind == "x":  # deleted one by one: the costs move evenly, and D is least
            low += 3 * n
            walks.append([("D" * n, q) for q in range(4)])
        else:
            v, more, walk = step(kind, v)
            low += more
            walks.append(walk)
    return tuple(x + low for x in v), walks[::-1]


def forward(walks: list, q: int) -> tuple[str, int]:
    edits = []
    for walk in walks:
        e, q = walk[q]
        edits.append(e)
    return "".join(edits), q


def _kinds(kinds: str, repeats: list[int]) -> list[tuple[str, int]]:
    return list(zip(kinds, repeats))


_ARRAYS = {"has_turn": "array<boolean>", "n_turn": "array<bigint>", "role": "array<string>", "head": "array<string>", "digest": "array<binary>", "copies": "array<bigint>"}
_PIECE = (
    {"k": "string", "p": "int", "edge": "boolean"} | _ARRAYS | {"kinds": "string", "repeats": "array<bigint>"} | dict.fromkeys(COUNTS, "bigint")
    | {"opens": "string", "closes": "string", "least": "bigint", "most": "bigint", "turns": "bigint", "moves": "array<double>", "gaps": "bigint", "cost": "bigint", "audit": "string"}
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _ddl(schema: dict) -> str:
    return ", ".join(f"{k} {v}" for k, v in schema.items())


def _batch(rows: list[dict], schema: dict) -> pa.RecordBatch:
    of = lambda t: pa.list_(_TYPES[t[6:-1]]) if t.startswith("array") else _TYPES[t]
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], of(t)) for k, t in schema.items()], list(schema))


def _piece(k: str, p: int, edge: bool, lines: list[tuple]) -> dict:
    """What one task holds of a conversation: its lines, what they are, its counts, and either its solution or its moves."""
    lines = [x for x in lines if x[5]]
    out = {"k": k, "p": p, "edge": edge, **{x: [r[i] for r in lines] for i, x in enumerate(_ARRAYS)}, **dict.fromkeys(COUNTS, 0), "turns": 0}
    runs = []
    for has, turn, role, _, _, n, blank, cut, first in lines:
        initial = role[:1]
        kept_one = first and not blank
        if kept_one:
            kind = initial if initial in OWN else "o"
            runs.append((kind.upper() if cut else kind, 1))
            out["truncated"] += cut
        if n > kept_one:
            runs.append(("x", n - kept_one))
        out["blank" if blank else "duplicate"] += n - kept_one
        out["illegal"] += n - 1 + ("opens" in out and out["closes"] + initial not in LEGAL)
        out.setdefault("opens", initial)
        out["closes"] = initial
        if has:
            out["turns"] += turn != out.get("most")
            out.setdefault("least", turn)
            out["most"] = turn
    out |= {"kinds": "".join(x for x, _ in runs), "repeats": [n for _, n in runs]}
    if edge:
        unit = [closed([0.0 if i == j else INF for i in range(4)]) for j in range(4)]
        ends = [backward(runs, u)[0] for u in unit]
        return out | {"moves": [ends[j][i] for i in range(4) for j in range(4)]}
    v, walks = backward(runs, TERMINAL)
    edits, q = forward(walks, 0)
    return out | {"gaps": _gaps(out.get("least"), out.get("most"), out["turns"]), "cost": int(v[0]), "audit": edits + TAIL[q]}


def _pieces(batches):
    p = TaskContext.get().partitionId()
    current, lines, n, ready = None, [], 0, []
    columns = ["k", *_ARRAYS, "blank", "cut", "first"]
    for batch in batches:
        for k, *line in zip(*(batch.column(x).to_pylist() for x in columns)):
            if k != current:
                if current is not None:
                    ready.append(_piece(current, p, n == 0, lines))
                    n += 1
                current, lines = k, []
            lines.append(line)
        if ready:
            yield _batch(ready, _PIECE)
            ready = []
    if current is not None:
        yield _batch([_piece(current, p, True, lines)], _PIECE)


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return 0 if least is None else min(most - least + 1 - turns, (1 << 63) - 1)


_CHAINED = {"k": "string", "p": "int", "ahead": "array<double>", "gaps": "bigint"} | dict.fromkeys(COUNTS, "bigint") | {"cost": "bigint"}


def _chain_back(table: pa.Table) -> pa.Table:
    """For each piece of a conversation, the costs to go behind it; with its first piece, the conversation's counts."""
    pieces = sorted(table.to_pylist(), key=lambda r: r["p"])
    v, rows = TERMINAL, []
    for r in reversed(pieces):
        rows.append({"k": r["k"], "p": r["p"], "ahead": list(v)})
        v = tuple(min(r["moves"][4 * i + j] + v[j] for j in range(4)) for i in range(4))
    total = {x: sum(r[x] for r in pieces) for x in COUNTS}
    inked = [r for r in pieces if r["opens"] is not None]
    total["illegal"] += sum(a["closes"] + b["opens"] not in LEGAL for a, b in zip(inked, inked[1:]))
    numbered = [r for r in pieces if r["least"] is not None]
    turns = sum(r["turns"] for r in numbered) - sum(a["most"] == b["least"] for a, b in zip(numbered, numbered[1:]))
    gaps = _gaps(numbered[0]["least"], numbered[-1]["most"], turns) if numbered else 0
    rows[-1] |= total | {"gaps": gaps, "cost": int(v[0])}
    return pa.Table.from_batches([_batch(rows, _CHAINED)])


_WALKED = {"k": "string", "p": "int", "audits": "array<string>", "ends": "array<int>"}


def _walk(batches):
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            _, walks = backward(_kinds(r["kinds"], r["repeats"]), tuple(r["ahead"]))
            done = [forward(walks, q) for q in range(4)]
            rows.append({"k": r["k"], "p": r["p"], "audits": [e for e, _ in done], "ends": [q for _, q in done]})
        yield _batch(rows, _WALKED)


_STARTED = {"k": "string", "p": "int", "start": "int", "tail": "string"}


def _chain_on(table: pa.Table) -> pa.Table:
    q, rows = 0, []
    for r in sorted(table.to_pylist(), key=lambda r: r["p"]):
        rows.append({"k": r["k"], "p": r["p"], "start": q, "tail": ""})
        q = r["ends"][q]
    rows[-1]["tail"] = TAIL[q]
    return pa.Table.from_batches([_batch(rows, _STARTED)])


_DECIDED = {"k": "string", "part": "int", "place": "bigint", "has_turn": "boolean", "n_turn": "bigint", "role": "string", "head": "string", "digest": "binary", "new_role": "string", "edit": "string"}


def _decide(batches):
    """The turns that each piece's audit leaves, in order; those put in have no digest."""
    due = lambda q: "user" if NEXT[q] == 2 else "assistant"
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            q, at, place, audit = r["start"], 0, 0, r["audit"]

            def put_in(q, at, place):
                while at < len(audit) and audit[at] == "I":
                    rows.append({"k": r["k"], "part": r["p"], "place": place, "new_role": due(q), "edit": "I"})
                    q, at, place = NEXT[q], at + 1, place + 1
                return q, at, place

            for has, turn, role, head, digest, n in zip(*(r[x] for x in _ARRAYS)):
                q, at, place = put_in(q, at, place)
                edit = audit[at]
                at += n
                if edit != "D":
                    rows.append({
                        "k": r["k"], "part": r["p"], "place": place, "has_turn": has, "n_turn": turn, "role": role, "head": head, "digest": digest,
                        "new_role": role if edit == "K" else due(q), "edit": edit,
                    })
                    q, place = OWN[role[:1]][q] if edit == "K" else NEXT[q], place + 1
            put_in(q, at, place)
        yield _batch(rows, _DECIDED)


def pieces_for(rows: int) -> int:
    """How many ranges: some eight thousand turns each, a thousand ranges from there on, a million turns at most."""
    return max(1, -(-rows // min(1 << 20, max(1 << 13, rows >> 10))))


def repair(rows: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of rows (conv_id, turn, role, text, and copies where rows stand for several).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. turns: conv_id, part, place, role, text,
    edit, in order by part and place within a conversation.
    """
    keyed = _keyed(rows)
    order = ["k", "has_turn", "n_turn", "role", "head", "digest"]
    lines = _lines(keyed).repartitionByRange(ranges or pieces_for(rows.count()), *order).sortWithinPartitions(*order)
    pieces = kept(lines.mapInArrow(_pieces, _ddl(_PIECE)))
    edges = pieces.where("edge")
    chained = kept(edges.select("k", "p", *COUNTS, "opens", "closes", "least", "most", "turns", "moves").groupBy("k").applyInArrow(_chain_back, _ddl(_CHAINED)))
    walked = kept(edges.select("k", "p", "kinds", "repeats").join(chained.select("k", "p", "ahead"), ["k", "p"]).mapInArrow(_walk, _ddl(_WALKED)))
    started = walked.select("k", "p", "ends").groupBy("k").applyInArrow(_chain_on, _ddl(_STARTED))
    solved = kept(walked.join(started, ["k", "p"]).select("k", "p", "start", F.concat(F.get("audits", "start"), "tail").alias("audit")))

    needed = ["k", "p", *_ARRAYS]
    decided = pieces.where("not edge").select(*needed, F.lit(0).alias("start"), "audit").unionByName(edges.select(*needed).join(solved, ["k", "p"]))
    decided = decided.mapInArrow(_decide, _ddl(_DECIDED))
    texts = keyed.where("copies > 0").select(*KEY, "text").dropDuplicates(KEY)
    turns = decided.where("digest is not null").join(texts, KEY).select("k", "part", "place", F.col("new_role").alias("role"), "text", "edit")
    turns = turns.unionByName(decided.where("digest is null").select("k", "part", "place", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit"))

    whole = pieces.where("not edge").select("k", "gaps", *COUNTS, "cost", "audit")
    joined = solved.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    whole = whole.unionByName(chained.where("cost is not null").select("k", "gaps", *COUNTS, "cost").join(joined, "k"))
    named = F.when(F.col("k") != "", F.substring("k", 2, 1 << 30)).cast(rows.schema["conv_id"].dataType).alias("conv_id")
    return whole.select(named, *[x for x in whole.columns if x != "k"]), turns.select(named, *[x for x in turns.columns if x != "k"])


def _hash(batches):
    current, digest = None, None
    for batch in batches:
        done = []
        for k, line in zip(batch.column("k").to_pylist(), batch.column("line").to_pylist()):
            if k == current:
                digest.update(b"\n")
            else:
                if digest:
                    done.append((current, digest.hexdigest()))
                current, digest = k, hashlib.sha256()
            digest.update(line)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done)], ["k", "repaired_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (current, digest.hexdigest())], ["k", "repaired_sha256"])


def hashed(turns: DataFrame) -> DataFrame:
    """(k, repaired_sha256): of each conversation's turns, `role:text`, joined by newlines; k as in `_keyed`."""
    t = turns.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("k"), "part", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    return t.repartition("k").sortWithinPartitions("k", "part", "place").select("k", "line").mapInArrow(_hash, "k string, repaired_sha256 string")


def repair_digests(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The counts, cost and audit of every conversation, and the hash of its repaired turns."""
    told, turns = repair(conversations, ranges)
    told = told.withColumn("k", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    out = told.join(hashed(turns), "k", "left").drop("k")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
