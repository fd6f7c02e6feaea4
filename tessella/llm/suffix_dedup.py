"""Operator 9: suffix-array dedup with a run-length index.

Which bytes are covered by a string of `LENGTH` bytes that starts anywhere else as well?

1. Anchors: the minimizer (smallest digest of `ANCHOR` bytes) of every window of LENGTH bytes. Equal windows have equal
   minimizers at equal places, so only windows whose anchor occurs twice can repeat. Groups of documents send distinct
   anchor digests, with the bytes of the stretches around them (see 2) as a power of two, and get two bits back:
   repeated, and hot (all its stretches take more than `HOT_BYTES`, too much for one bucket).
2. Around every repeated anchor the stretch of text that its windows span is sent to the anchor's bucket, equal
   stretches once per group. A stretch that comes twice is marked whole.
3. A bucket joins its stretches, sorts the suffixes (as far as the longest stretch), and run-compresses the Burrows-Wheeler
   transform. Only the suffixes at the ends of its runs keep a sample: their place and the length they share with their
   neighbour. Streaming over the text, the matching length at a place is the larger of its sample and the length at the
   place before less one. Windows whose matching length reaches LENGTH are marked.
4. Windows of hot anchors (the edges of a passage that a large part of all documents holds are all different, yet meet
   at one anchor) are keyed one by one by their own digest, which spreads them; equal digests are marked.

Digests have 64 bits; anchors only pick candidates, so only windows of hot anchors rely on them.

Edge cases: null texts are empty; texts shorter than LENGTH keep all bytes; repeats inside one document count, overlaps
too; rows that repeat a doc_id are separate documents; null doc_ids are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as c

LENGTH = 200
ANCHOR = 56
HOT_BYTES = 1 << 19
BUCKET_BYTES = 1 << 20
BUCKET_ENTRIES = 1 << 20
SEPARATOR = 0xFF  # no byte of UTF-8 text

_ROLL = c.Rolling(9)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _minimizers(h: np.ndarray, span: int) -> np.ndarray:
    """For every `span` consecutive digests, the place of the smallest (the first of equals)."""
    n = len(h) - span + 1
    # digest in the upper bits, place in the lower ones: one running minimum finds both
    wide = -(-len(h) // span) * span
    key = np.full(wide, np.uint64(2**64 - 1))
    low = np.uint64(max(1, int(len(h)).bit_length()))
    key[: len(h)] = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    blocks = key.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
    return (best & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


class _Group:
    """The bytes of one group of documents and its anchors: digest, place, and the windows [lo, hi) that it rules."""

    def __init__(self, docs: pa.Table, length: int, anchor: int):
        docs = docs.take(pc.sort_indices(docs.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        self.ids = docs.column("doc_id").combine_chunks()
        self.data, self.offs = c.utf8(docs.column("text"))
        self.length, parts = length, []
        span = length - anchor + 1
        for a, b in c.chunks(self.offs):
            lo, hi = int(self.offs[a]), int(self.offs[b])
            if hi - lo < length:
                continue
            h = _ROLL.every(_ROLL.sums(_ROLL.code[self.data[lo:hi]]), anchor)
            place = _minimizers(h, span)
            starts = np.arange(len(place))
            cut = self.offs[a : b + 1] - lo  # no window crosses the end of its document
            fits = np.zeros(len(place) + length, np.int32)
            long = np.flatnonzero(np.diff(cut) >= length)
            np.add.at(fits, cut[:-1][long], 1)
            np.add.at(fits, cut[1:][long] - length + 1, -1)
            starts = starts[np.cumsum(fits)[: len(place)] > 0]
            if not len(starts):
                continue
            p = place[starts]
            head = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
            first, last = starts[head], starts[np.r_[head[1:] - 1, len(starts) - 1]]
            # minima crowd at small digests; mixed anew they spread evenly over the buckets
            parts.append((c.mix(h[p[head]] ^ _SPREAD), p[head] + lo, first + lo, last + lo + 1))
        cat = lambda k, t: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, t)
        self.digest, self.place, self.lo, self.hi = cat(0, np.uint64), cat(1, np.int64), cat(2, np.int64), cat(3, np.int64)


def _cuts(uniq: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    cut = np.searchsorted(c.bucket_of(uniq, n), np.arange(n + 1))
    return cut, np.flatnonzero(np.diff(cut))


ANCHORS = "bucket int, g int, n int, digests binary, twice binary, size binary"
ANCHOR_REPLY = "g int, bucket int, n int, repeated binary, hot binary"
SENT = "bucket int, g int, kind int, n int, keys binary, body binary"
VERDICT = "g int, kind int, bucket int, n int, flags binary"


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uniq, which, n = np.unique(h, return_inverse=True, return_counts=True)
    return uniq, which, n


def _send_anchors(n_buckets: int, length: int, anchor: int):
    def f(key, docs):
        group = _Group(docs, length, anchor)
        uniq, which, n = _distinct(group.digest)
        size = np.bincount(which, weights=group.hi - group.lo + length - 1, minlength=len(uniq))
        power = np.ceil(np.log2(size)).astype(np.uint8)
        cut, some = _cuts(uniq, n_buckets)
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "g": pa.array([key[0].as_py()] * len(some), pa.int32()), "n": pa.array(np.diff(cut)[some], pa.int32()),
            "digests": pa.array([uniq[cut[k] : cut[k + 1]].astype(np.uint32).tobytes() for k in some], pa.binary()),
            "twice": pa.array([c.bits(n[cut[k] : cut[k + 1]] > 1) for k in some], pa.binary()),
            "size": pa.array([power[cut[k] : cut[k + 1]].tobytes() for k in some], pa.binary()),
        })

    return f


def _count_anchors(hot_bytes: int):
    def f(blocks: pa.Table) -> pa.Table:
        ns = blocks.column("n").to_numpy()
        h = np.frombuffer(b"".join(blocks.column("digests").to_pylist()), np.uint32)
        twice = np.concatenate([c.unbits(x, k) for x, k in zip(blocks.column("twice").to_pylist(), ns)])
        order = np.argsort(h)
        s = h[order]
        head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[head, len(s)])
        repeated, hot = np.empty(len(h), bool), np.empty(len(h), bool)
        repeated[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], head), size)
        power = np.frombuffer(b"".join(blocks.column("size").to_pylist()), np.uint8)
        hot[order] = np.repeat(np.add.reduceat(np.exp2(power[order].astype(float)), head) > hot_bytes, size)
        cut = np.r_[0, np.cumsum(ns)]
        part = lambda x: pa.array([c.bits(x[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())
        return pa.table({"g": blocks.column("g"), "bucket": blocks.column("bucket"), "n": blocks.column("n"), "repeated": part(repeated), "hot": part(hot)})

    return f


def _read(replies: pa.Table, column: str) -> np.ndarray:
    got = [c.unbits(x, k) for x, k in zip(replies.column(column).to_pylist(), replies.column("n").to_pylist())]
    return np.concatenate(got) if got else np.zeros(0, bool)


def _near(places: np.ndarray, most: int = 1 << 19):
    """Ranges of (sorted) places that lie within `most` bytes of the first."""
    x = 0
    while x < len(places):
        y = int(np.searchsorted(places, places[x] + most))
        yield x, y
        x = y


def _stretches(group: _Group, picked: np.ndarray):
    """Anchors picked, their stretches of text, and which of the distinct stretches each is: (digest, first holder, which, count)."""
    lo, hi = group.lo[picked], group.hi[picked] + group.length - 1
    # the stretch's own digest tells equal stretches apart; the anchor's digest, first, orders them by bucket
    own = np.zeros(len(picked), np.uint64)
    for x, y in _near(lo):
        a, b = lo[x:y] - lo[x], hi[x:y] - lo[x]
        own[x:y] = _ROLL.slices(_ROLL.sums(_ROLL.code[group.data[lo[x] : lo[x] + b.max()]]), a, b) + (b - a).astype(np.uint64)
    order = np.lexsort((own, group.digest[picked]))
    d, o = group.digest[picked][order], own[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (o[1:] != o[:-1])]) if len(order) else np.zeros(0, np.int64)
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(order)]))
    return lo, hi, order[head], which, np.diff(np.r_[head, len(order)])


def _windows(group: _Group, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the hot anchors and their digests."""
    size = group.hi[hot] - group.lo[hot]
    end = np.cumsum(size)
    starts = np.repeat(group.lo[hot] - (end - size), size) + np.arange(end[-1] if len(end) else 0)
    own = np.zeros(len(starts), np.uint64)
    for x, y in _near(starts):
        a = starts[x:y] - starts[x]
        own[x:y] = _ROLL.slices(_ROLL.sums(_ROLL.code[group.data[starts[x] : starts[y - 1] + group.length]]), a, a + group.length)
    return starts, own


def _kinds(group: _Group, replies: pa.Table):
    uniq, which, _ = _distinct(group.digest)
    replies = replies.sort_by("bucket")
    repeated, hot = _read(replies, "repeated")[which], _read(replies, "hot")[which]
    return np.flatnonzero(repeated & ~hot), np.flatnonzero(repeated & hot)


def _send_stretches(n_buckets: int, n_digest: int, length: int, anchor: int):
    def f(key, docs, replies):
        group = _Group(docs, length, anchor)
        picked, hot = _kinds(group, replies)
        lo, hi, rep, _, many = _stretches(group, picked)
        rows = {k: [] for k in ("bucket", "kind", "n", "keys", "body")}

        def add(bucket, kind, n, keys, body):
            for k, v in zip(rows, (bucket, kind, n, keys, body)):
                rows[k].append(v)

        digest = group.digest[picked][rep]
        cut, some = _cuts(digest, n_buckets)
        head = np.empty((len(rep), 3), np.uint32)  # low half of the anchor, bytes, whether the group holds it twice
        head[:, 0], head[:, 1], head[:, 2] = digest.astype(np.uint32), hi[rep] - lo[rep], many > 1
        for k in some:
            mine = rep[cut[k] : cut[k + 1]]
            add(k, 0, len(mine), head[cut[k] : cut[k + 1]].tobytes(), b"".join(group.data[lo[x] : hi[x]].tobytes() for x in mine))
        # hot windows go by their own digests, to buckets behind the others
        _, own = _windows(group, hot)
        uniq, _, n = _distinct(own)
        cut, some = _cuts(uniq, n_digest)
        for k in some:
            add(n_buckets + k, 1, cut[k + 1] - cut[k], uniq[cut[k] : cut[k + 1]].tobytes(), c.bits(n[cut[k] : cut[k + 1]] > 1))
        # what is a candidate, so that nothing below needs the anchors' replies again
        yes = np.zeros(len(group.digest), np.uint8)
        yes[picked], yes[hot] = 1, 2
        add(-1 - key[0].as_py(), 2, len(yes), b"", yes.tobytes())
        ints = lambda k: pa.array(np.array(rows[k], np.int64), pa.int32())
        return pa.table({
            "bucket": ints("bucket"), "g": pa.array([key[0].as_py()] * len(rows["n"]), pa.int32()), "kind": ints("kind"), "n": ints("n"),
            "keys": pa.array(rows["keys"], pa.binary()), "body": pa.array(rows["body"], pa.binary()),
        })

    return f


def suffix_order(text: np.ndarray, upto: int) -> np.ndarray:
    """Suffixes sorted by their first `upto` bytes at least, by doubling."""
    n = len(text)
    padded = np.r_[text, np.full(8, SEPARATOR, np.uint8)]
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    h = 8
    while True:
        order = np.argsort(key)
        s = key[order]
        new = np.r_[False, s[1:] != s[:-1]]
        if h >= upto or new.sum() == n - 1:
            return order
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new).astype(np.uint64) + np.uint64(1)
        key = rank << np.uint64(32)
        key[: n - h] |= rank[h:]
        h *= 2


def run_ends(text: np.ndarray, order: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Neighbours (k, k + 1) in suffix order between which a run of the Burrows-Wheeler transform ends.

    A suffix that begins a stretch has no byte before it and is a run of its own.
    """
    bwt = text[order - 1].astype(np.int16)
    bwt[np.isin(order, begins, assume_unique=True)] = -1
    return np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] < 0))


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at a and b share, at most `most`."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    padded = np.r_[text, np.full(8, SEPARATOR, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = (word[x] == word[y])
        step = np.where(same.all(axis=1), 8, same.argmin(axis=1))
        out[live] += step
        live = live[(step == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


def matching_lengths(text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For every place, the most bytes that it shares with another place, streamed from samples at the ends of the
    runs of the transform; stretches are [begins, ends) and nothing matches beyond their ends."""
    n = len(text)
    order = suffix_order(text, int((ends - begins).max()) + 1)  # streaming needs whole lengths
    k = run_ends(text, order, begins)
    a, b = order[k], order[k + 1]
    stretch_end = np.repeat(ends, np.diff(np.r_[begins, n]))
    room = np.minimum(stretch_end[a] - a, stretch_end[b] - b)
    got = shared(text, a, b, room)
    sample = np.zeros(n, np.int64)
    np.maximum.at(sample, a, got)
    np.maximum.at(sample, b, got)
    at = np.arange(n)
    return np.maximum.accumulate(sample + at) - at


def _index(length: int, n_buckets: int):
    def f(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:  # a group's own note
            return pa.table({"g": sent.column("g"), "kind": sent.column("kind"), "bucket": sent.column("bucket"), "n": sent.column("n"), "flags": sent.column("body")})
        ns = sent.column("n").to_numpy()
        if bucket >= n_buckets:
            h = np.frombuffer(b"".join(sent.column("keys").to_pylist()), np.uint64)
            twice = np.concatenate([c.unbits(x, k) for x, k in zip(sent.column("body").to_pylist(), ns)])
            order = np.argsort(h)
            s = h[order]
            head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            size = np.diff(np.r_[head, len(s)])
            flags = np.empty(len(h), bool)
            flags[order] = np.repeat((size > 1) | np.logical_or.reduceat(twice[order], head), size)
            cut = np.r_[0, np.cumsum(ns)]
            out = [c.bits(flags[x:y]) for x, y in zip(cut[:-1], cut[1:])]
        else:
            head = np.frombuffer(b"".join(sent.column("keys").to_pylist()), np.uint32).reshape(-1, 3)
            body = b"".join(sent.column("body").to_pylist())
            size = head[:, 1].astype(np.int64)
            cut = np.r_[0, np.cumsum(size)]
            seen: dict[bytes, int] = {}  # equal stretches collapse
            which = np.array([seen.setdefault(body[x:y], len(seen)) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())])
            first = np.unique(which, return_index=True)[1]
            whole = np.bincount(which, weights=1 + head[:, 2]) > 1
            anchors, of, lone = np.unique(head[first, 0], return_inverse=True, return_counts=True)
            texts = list(seen)
            need = np.flatnonzero(lone[of] > 1)  # an anchor with one distinct stretch has nothing to compare
            marks = [np.ones(len(t) - length + 1, bool) if whole[k] else np.zeros(len(t) - length + 1, bool) for k, t in enumerate(texts)]
            if len(need) and not whole[need].all():
                text = np.frombuffer(b"".join(texts[k] + b"\xff" for k in need), np.uint8)
                sizes = np.array([len(texts[k]) + 1 for k in need])
                begins = np.r_[0, np.cumsum(sizes)[:-1]]
                ml = matching_lengths(text, begins, begins + sizes - 1) >= length
                for k, x in zip(need, begins):
                    marks[k] |= ml[x : x + len(marks[k])]
            per = [np.packbits(m).tobytes() for m in marks]
            row = np.r_[0, np.cumsum(ns)]
            out = [b"".join(per[k] for k in which[x:y]) for x, y in zip(row[:-1], row[1:])]
        return pa.table({"g": sent.column("g"), "kind": sent.column("kind"), "bucket": sent.column("bucket"), "n": sent.column("n"), "flags": pa.array(out, pa.binary())})

    return f


def _marked(group: _Group, verdict: pa.Table) -> np.ndarray:
    """The bytes to remove."""
    verdict = verdict.sort_by("bucket")
    of = lambda k: verdict.filter(pc.equal(verdict.column("kind"), k))
    yes = np.frombuffer(of(2).column("flags")[0].as_py(), np.uint8)
    picked, hot = np.flatnonzero(yes == 1), np.flatnonzero(yes == 2)
    hits = []
    lo, hi, rep, which, _ = _stretches(group, picked)
    raw = np.frombuffer(b"".join(of(0).column("flags").to_pylist()), np.uint8)
    windows = hi[rep] - lo[rep] - group.length + 1
    at = np.r_[0, np.cumsum(-(-windows // 8))]
    flags = np.unpackbits(raw)
    size = group.hi[picked] - group.lo[picked]
    end = np.cumsum(size)
    inner = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
    hit = flags[np.repeat(8 * at[:-1][which], size) + inner].astype(bool)
    hits.append((np.repeat(lo, size) + inner)[hit])
    starts, own = _windows(group, hot)
    _, which, _ = _distinct(own)
    flags = _read(of(1), "flags")
    hits.append(starts[flags[which]])
    hits = np.concatenate(hits)
    return c.spread(hits, hits + group.length, len(group.data))


def repeated_bytes(docs: DataFrame, finish, schema: str, length: int = LENGTH, anchor: int = ANCHOR, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Marks every byte that a repeated string of `length` bytes covers; `finish(group, removed)` makes each group's rows."""
    total = c.text_bytes(docs)
    grouped = c.in_groups(docs, total)
    n = c.buckets(total // 50, BUCKET_ENTRIES)
    n_text = c.buckets(total, BUCKET_BYTES)
    anchors = grouped.groupBy("g").applyInArrow(_send_anchors(n, length, anchor), ANCHORS)
    replies = anchors.groupBy("bucket").applyInArrow(_count_anchors(hot_bytes), ANCHOR_REPLY)
    sent = grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(_send_stretches(n_text, n_text, length, anchor), SENT)
    verdict = sent.groupBy("bucket").applyInArrow(_index(length, n_text), VERDICT)

    def last(key, docs, verdict):
        group = _Group(docs, length, anchor)
        return finish(group, _marked(group, verdict))

    return grouped.groupBy("g").cogroup(verdict.groupBy("g")).applyInArrow(last, schema)


def _digests(group: _Group, removed: np.ndarray) -> pa.Table:
    n = np.diff(group.offs)
    gone = np.r_[0, np.cumsum(removed)]
    head = removed & ~np.r_[False, removed[:-1]]
    inner = group.offs[:-1][n > 0]
    head[inner] = removed[inner]  # a run ends with its document
    spans = np.r_[0, np.cumsum(head)]
    keep = group.data[~removed]
    at = group.offs - gone[group.offs]
    sha = [hashlib.sha256(keep[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:])]
    per = lambda x: pa.array(x[group.offs[1:]] - x[group.offs[:-1]], pa.int64())
    return pa.table({"doc_id": group.ids, "n_bytes": pa.array(n, pa.int64()), "n_removed": per(gone), "n_spans": per(spans), "kept_sha256": pa.array(sha, pa.string())})


def suffix_dedup_digests(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_bytes: int = HOT_BYTES) -> DataFrame:
    return repeated_bytes(docs, _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, anchor, hot_bytes)


def _spans(group: _Group, removed: np.ndarray) -> pa.Table:
    inner = np.zeros(len(removed) + 1, bool)
    inner[group.offs] = True  # a run ends with its document
    starts = np.flatnonzero(removed & (~np.r_[False, removed[:-1]] | inner[:-1]))
    ends = np.flatnonzero(removed & (~np.r_[removed[1:], False] | inner[1:])) + 1
    row = np.searchsorted(group.offs, starts, side="right") - 1
    return pa.table({"doc_id": group.ids.take(pa.array(row)), "start": pa.array(starts - group.offs[row], pa.int64()), "length": pa.array(ends - starts, pa.int64())})


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(doc_id, start, length) in bytes of every maximal repeated span."""
    return repeated_bytes(docs, _spans, "doc_id long, start long, length long", length, anchor, hot_bytes)
