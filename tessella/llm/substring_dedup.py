"""Operator 3: substring dedup by level-wise doubling of repeated word windows.

Windows of a short length are digested first; only those repeated in two documents are extended to (at most) twice
the length, and so on up the ladder (``7 -> 13``, ``7 -> 13 -> 25 -> 50``), until the wanted length is reached or no
candidate survives. A longer window is a candidate only if the two windows of the previous length that cover it both
repeat, so each level digests what the level before left over.

Digests travel as sorted blocks, distinct within a group of documents, to buckets of the digest space; a bucket
answers with one bit per digest. Nothing but digests and bits is shuffled between the levels, and a window that a
third of all documents share costs one digest per group.

Digests of the last level have 64 bits; for n windows about n*n / 2**65 false repeats are expected.

Edge cases: null and empty texts have no words; documents with a null doc_id sort after all others and are never
"smaller" than one another, nor are rows that repeat a doc_id; repeats inside one document alone are kept; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW = 13
SHORTEST = 7
BUCKET_ENTRIES = 1 << 20

_WORD = c.Rolling(3)
_SEQ = c.Rolling(33)


def ladder(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from short to long, each at most twice the one before."""
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class _Group:
    """Words of one group of documents and the windows that are still candidates."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").combine_chunks()
        order = pc.sort_indices(docs.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        docs, ids = docs.take(order), ids.take(order)
        self.rest = docs.column("rest") if "rest" in docs.column_names else None
        self.ids_null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(c.NO_ID).to_numpy()
        self.data, self.offs = c.utf8(docs.column("text"))
        parts, self.first, n = [], np.zeros(len(self.offs), np.int64), 0
        for a, b in c.chunks(self.offs):
            lo = self.offs[a]
            s, e, first = c.words(data := self.data[lo : self.offs[b]], self.offs[a : b + 1] - lo)
            parts.append(((s + lo).astype(np.int32), (e + lo).astype(np.int32), c.word_hashes(data, s, e, _WORD)))
            self.first[a : b + 1] = first + n
            n += len(s)
        cat = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t)
        self.starts, self.ends = cat(0, np.int32), cat(1, np.int32)
        self.row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))
        hashes = cat(2, np.uint64)
        del parts
        self.sums = _SEQ.sums(hashes)

    def fits(self, length: int) -> np.ndarray:
        """Whether a window of that many words starts at each word."""
        out = np.zeros(len(self.row), bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            out[a : max(a, b - length + 1)] = True
        return out

    def digests(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`common.distinct` of the windows at these starts."""
        return c.distinct(_SEQ.slices(self.sums, at, at + length))


def _blocks(g: int, at: np.ndarray, n_words: int, uniq: np.ndarray, own: np.ndarray, n: int, full: bool) -> pa.Table:
    """One row per bucket: the group's digests there and what it says of each. A row of bucket -1 - g keeps the candidate starts."""
    cut = np.searchsorted(c.bucket_of(uniq, n), np.arange(n + 1))
    full_at = np.flatnonzero(np.diff(cut))
    sent = uniq if full else uniq.astype(np.uint32)
    pick = lambda a, b: own[a:b].tobytes() if full else c.bits(own[a:b])
    starts = np.zeros(n_words, bool)
    starts[at] = True
    return pa.table({
        "bucket": pa.array(np.r_[-1 - g, full_at], pa.int32()), "g": pa.array(np.full(len(full_at) + 1, g), pa.int32()),
        "n": pa.array(np.r_[n_words, np.diff(cut)[full_at]], pa.int32()),
        "digests": pa.array([c.bits(starts), *(sent[cut[k] : cut[k + 1]].tobytes() for k in full_at)], pa.binary()),
        "own": pa.array([b"", *(pick(cut[k], cut[k + 1]) for k in full_at)], pa.binary()),
    })


BLOCK = "bucket int, g int, n int, digests binary, own binary"
REPLY = "g int, bucket int, n int, flags binary"


def _answers(full: bool):
    """For a bucket: whether each digest occurs in two documents (or, at the last level, in one before the group's)."""

    def f(key: tuple[pa.Scalar, ...], blocks: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return pa.table({"g": blocks.column("g"), "bucket": pa.array([-1] * len(blocks), pa.int32()), "n": blocks.column("n"), "flags": blocks.column("digests")})
        ns = blocks.column("n").to_numpy()
        read = lambda k, t: np.frombuffer(b"".join(blocks.column(k).to_pylist()), t)
        h = read("digests", np.uint64 if full else np.uint32)
        own = read("own", np.int64) if full else np.concatenate([c.unbits(x, k) for x, k in zip(blocks.column("own").to_pylist(), ns)])
        order = np.argsort(h)
        s = h[order]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        if full:
            flag = np.repeat(np.minimum.reduceat(own[order], head), size) < own[order]
        else:
            flag = np.repeat((size > 1) | np.logical_or.reduceat(own[order], head), size)
        flags = np.empty(len(h), bool)
        flags[order] = flag
        cut = np.r_[0, np.cumsum(ns)]
        return pa.table({
            "g": blocks.column("g"), "bucket": blocks.column("bucket"), "n": blocks.column("n"),
            "flags": pa.array([c.bits(flags[cut[k] : cut[k + 1]]) for k in range(len(ns))], pa.binary()),
        })

    return c.released(f)


def _repeated(group: _Group, replies: pa.Table, length: int):
    """The candidate starts of the level that was answered, the answer for each, and what `distinct` says of their digests."""
    replies = replies.sort_by("bucket")
    got = [c.unbits(x, k) for x, k in zip(replies.column("flags").to_pylist(), replies.column("n").to_pylist())]
    at = np.flatnonzero(got[0])
    _, order, head = group.digests(at, length)
    return at, (c.dealt_back(np.concatenate(got[1:]), order, head) if len(got) > 1 else np.zeros(0, bool)), order, head


def _least(ids: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The smallest id of every distinct digest."""
    return np.minimum.reduceat(ids[order], head) if len(head) else ids[:0]


def _send(lengths: list[int], level: int, n_buckets: int):
    last = level == len(lengths) - 1

    def f(key, docs, replies=None):
        group = _Group(docs)
        room = group.fits(lengths[level])
        if level:
            at, hit, _, _ = _repeated(group, replies, lengths[level - 1])
            before = np.zeros(len(room), bool)
            before[at[hit]] = True
            n, shift = len(room), min(len(room), lengths[level] - lengths[level - 1])
            room[: n - shift] &= before[: n - shift] & before[shift:]
            room[n - shift :] = False
        at = np.flatnonzero(room)
        uniq, order, head = group.digests(at, lengths[level])
        ids = group.ids[group.row[at]]
        own = _least(ids, order, head)
        if not last:  # occurs in two documents of the group
            own = -_least(-ids, order, head) != own
        return _blocks(key[0].as_py(), at, len(room), uniq, own, n_buckets, last)

    return c.released(f) if level else c.released(lambda key, docs: f(key, docs))


def covered(docs: DataFrame, total_bytes: int, window: int, finish, schema: str, shortest: int = SHORTEST, rest: bool = False) -> DataFrame:
    """Runs the ladder over (doc_id, text) and hands `finish(group, removed_words)` each group's verdict.

    removed_words marks the words that a window covers whose words also start in a document of smaller id.
    """
    lengths = ladder(window, shortest)
    grouped = c.in_groups(docs, total_bytes, rest)
    n = c.buckets(total_bytes // 6, BUCKET_ENTRIES)
    replies = None
    for k in range(len(lengths)):
        by_g = grouped.groupBy("g")
        blocks = (by_g.cogroup(replies.groupBy("g")) if k else by_g).applyInArrow(_send(lengths, k, n), BLOCK)
        replies = blocks.groupBy("bucket").applyInArrow(_answers(k == len(lengths) - 1), REPLY)

    def last(key, docs, replies):
        group = _Group(docs)
        at, elsewhere, order, head = _repeated(group, replies, window)
        ids = group.ids[group.row[at]]
        hit = at[elsewhere | (c.dealt_back(_least(ids, order, head), order, head) < ids)]
        group.sums = None  # only words and bytes are needed from here
        return finish(group, c.spread(hit, hit + window, len(group.row)))

    return grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(c.released(last), schema)


def _digests(group: _Group, removed: np.ndarray) -> pa.Table:
    """Per document: words, removed words, and the SHA-256 of the kept words joined by one space."""
    n = np.diff(group.first)
    gone = np.add.reduceat(np.r_[removed, False].astype(np.int64), group.first[:-1]) * (n > 0) if len(n) else n
    keep = ~removed
    s, e, row = group.starts[keep], group.ends[keep], group.row[keep]
    first = np.searchsorted(row, np.arange(len(n) + 1))
    sha = []
    for a, b in zip(first[:-1], first[1:]):  # each kept word and a space, copied by one gather
        size = e[a:b].astype(np.int64) - s[a:b] + 1
        to = np.cumsum(size)
        at = np.repeat(s[a:b] - (to - size), size) + np.arange(to[-1] if b > a else 0)
        out = group.data[np.minimum(at, len(group.data) - 1)]
        out[to - 1] = 0x20
        sha.append(hashlib.sha256(out[:-1].tobytes()).hexdigest())
    ids = pa.array(group.ids, pa.int64(), mask=group.ids_null)
    return pa.table({"doc_id": ids, "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})


def substring_dedup_digests(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    return covered(docs, c.text_bytes(docs), window, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string", shortest)


def _texts(group: _Group, removed: np.ndarray) -> pa.Table:
    """Per document: the text without the removed words and the white space after each."""
    upto = np.r_[group.starts[1:], len(group.data)] if len(group.starts) else group.starts
    upto = np.minimum(upto, group.offs[1:][group.row])
    gone = c.spread(group.starts[removed], upto[removed], len(group.data))
    data = group.data[~gone]
    offs = np.r_[0, np.cumsum(~gone)][group.offs]
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:])]
    n = np.diff(group.first)
    n_removed = np.add.reduceat(np.r_[removed, False].astype(np.int64), group.first[:-1]) * (n > 0) if len(n) else n
    return pa.table({"rest": group.rest, "text": pa.array(texts, pa.string()), "n_removed": pa.array(n_removed, pa.int64())})


def substring_dedup(docs: DataFrame, window: int = WINDOW, shortest: int = SHORTEST, count: str = "n_removed") -> DataFrame:
    """All columns of docs, the text without the words that an earlier document's windows cover, and their number as `count`."""
    rest = docs.drop("text").schema.simpleString()
    out = covered(docs, c.text_bytes(docs), window, _texts, f"rest {rest}, text string, n_removed long", shortest, rest=True)
    return out.select(*[F.col("text") if x == "text" else F.col(f"rest.`{x}`") for x in docs.columns], F.col("n_removed").alias(count))
