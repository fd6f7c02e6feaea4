"""Operator 7: packing documents into token sequences by first-fit decreasing.

Documents are dealt to randomised groups (a seeded hash of doc_id) of about `common.GROUP_BYTES` of text; groups are
packed independently. Inside a group, every document is tokenised and closed with an end id, whole sequences are cut off
its front, and the rests are placed by first-fit decreasing: a tournament tree over the bins' free room finds the first
bin that still takes a rest in logarithmic time. As documents may be cut freely, gaps that remain are filled from the
last bins, and the one bin that stays partly filled is dealt to sequences of lengths that are powers of two, which need
no padding. `cut=False` leaves the bins as first-fit decreasing made them.

Ids are those of the tokenizer file given, by its own library. Byte-level BPE never merges across a blank that begins a
pre-token, so a group's texts are cut there and every distinct unit is encoded once; the ids equal those of whole texts.

Edge cases: null and empty texts are the end id alone; null and repeated doc_ids are packed like any other row; texts
longer than a sequence span several; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common as c

LENGTH = 2048
END_ID = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# Classes of bytes by which texts are cut into units. What is in no class is never cut at.
_BLANK, _LETTER, _DIGIT, _MARK, _INK = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
for _a, _z in ("AZ", "az"):
    _KIND[ord(_a) : ord(_z) + 1] = _LETTER | _INK
_KIND[ord("0") : ord("9") + 1] = _DIGIT | _INK
for _x in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~":
    _KIND[_x] = _MARK | _INK
_KIND[ord("'")] = _INK  # may begin a contraction
#: Two-byte characters that are letters, all but the signs of multiplication and division; first bytes of other ink.
_LETTER_LEADS = np.zeros(256, bool)
_LETTER_LEADS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True
_INK_LEADS = np.zeros(256, bool)
_INK_LEADS[0xC3:0xE1] = _INK_LEADS[0xE4:0xF5] = True
_INK_AFTER = (_KIND & _INK > 0) | _INK_LEADS
LONG_UNIT = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


@functools.cache
def _splits_at_blanks(path: str) -> tuple[bool, tuple[str, ...]]:
    """Whether the tokenizer cuts texts before single blanks and merges nothing across cuts; and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    plain = plain and sum(len(x) == 1 for x in spec["model"]["vocab"]) >= 256  # every byte has an id, so none is lost
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and byte_level, tuple(x["content"] for x in spec.get("added_tokens", []))


def _flat(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each has; about `common.CHUNK_BYTES` characters go to the library at a time."""
    flat, n = [np.zeros(0, "<u4")], []
    for a, b in c.chunks(np.r_[0, np.cumsum([len(t) for t in texts])]):
        ids = [x.ids for x in _tokenizer(path).encode_batch_fast(texts[a:b], add_special_tokens=False)]
        n += map(len, ids)
        flat.append(np.fromiter(itertools.chain.from_iterable(ids), "<u4"))
    return np.concatenate(flat), np.array(n, np.int64)


@functools.cache
def _id_bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for: byte-level tokens have a character for each."""
    vocabulary = _tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    return out


def _joined(data: np.ndarray, starts: np.ndarray, size: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As `_flat`, for units that a blank leads: these stay apart in one text, and the ids' bytes tell where each ends."""
    flat, n = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for a, b in c.chunks(np.r_[0, np.cumsum(size)]):
        stop = np.cumsum(size[a:b])
        text = data[np.repeat(starts[a:b] - (stop - size[a:b]), size[a:b]) + np.arange(stop[-1])].tobytes().decode()
        ids = np.array(_tokenizer(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(_id_bytes(path)[ids]), stop) + 1
        flat.append(ids)
        n.append(np.diff(np.r_[0, ends]))
    return np.concatenate(flat), np.concatenate(n)


def _whole(texts: list[str], path: str) -> list[np.ndarray]:
    flat, n = _flat(texts, path)
    return np.split(flat, np.cumsum(n)[:-1]) if len(n) else []


def _units(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the units that texts are cut into: a text's begin, and places where a pre-token surely begins, whatever is around."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        kind, before = _KIND[data], np.zeros(n, np.uint8)  # before: the kind of the character before each byte
        before[1:] = kind[:-1]
        two = np.flatnonzero(_LETTER_LEADS[data[:-1]] & (data[:-1] >= 0xC3) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))))
        before[two[two < n - 2] + 2] = _LETTER | _INK
        ink = _INK_AFTER[data]
        # white space after ink; a blank that goes with the ink after it; marks after letters or digits and the reverse
        cut[:n] = (kind & _BLANK > 0) & (before & _INK > 0)
        cut[: n - 1] |= (data[:-1] == 0x20) & ink[1:]
        cut[:n] |= (kind & _MARK > 0) & (before & (_LETTER | _DIGIT) > 0)
        cut[:n] |= (kind & (_LETTER | _DIGIT) > 0) & (before & _MARK > 0)
        ends = offs[1:][offs[1:] > 0] - 1  # a blank that ends a text has nothing after it
        cut[ends] &= (kind[ends] & _BLANK == 0) | (before[ends] & _INK > 0)
    cut[offs] = True
    cut[n] = False
    return np.flatnonzero(cut)


def _same_units(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first unit of each distinct one, and for every unit the number of its distinct one. Bytes decide, not digests."""
    words = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(8, np.uint8)], 8)
    read = lambda at, left: words[at].view("<u8").ravel() & _MASK[np.minimum(left, 8)]
    h = size.astype(np.uint64)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        h[live] = c.mix(h[live] * np.uint64(3) + read(starts[live] + k, size[live] - k))
        k += 8
        live = live[size[live] > k]
    _, order, head = c.distinct(h)
    which = c.dealt_back(np.arange(len(head)), order, head)
    first = order[head].astype(np.int64)
    rep = first[which]
    wrong = size != size[rep]
    live, k = np.flatnonzero(~wrong & (size > 0)), 0
    while len(live):
        wrong[live] |= read(starts[live] + k, size[live] - k) != read(starts[rep[live]] + k, size[live] - k)
        k += 8
        live = live[size[live] > k]
    odd = np.flatnonzero(wrong)  # digests met by chance: each is a distinct unit of its own
    which[odd] = len(first) + np.arange(len(odd))
    return np.r_[first, odd], which


def encode(col: pa.Array | pa.ChunkedArray, path: str) -> list[np.ndarray]:
    """Every text's token ids and the end id.

    Where the tokenizer cuts before blanks, texts are cut there first and the library encodes each distinct unit of the
    group once; one gather puts the ids together. Texts that hold a special string are given to the library whole, as are
    all texts under other tokenizers.
    """
    data, offs = c.utf8(col)
    by_blanks, special = _splits_at_blanks(path)
    raw = data.tobytes()
    whole = np.zeros(len(offs) - 1, bool)
    if not by_blanks:
        whole[:] = True
    elif any(x.encode() in raw for x in special):
        whole[:] = [any(x.encode() in raw[a:b] for x in special) for a, b in zip(offs[:-1], offs[1:])]
    starts = _units(data, offs)
    ends = np.r_[starts[1:], len(data)]
    row = np.searchsorted(offs, starts, side="right") - 1
    mine = ~whole[row]
    starts, ends, row = starts[mine], ends[mine], row[mine]
    size = ends - starts
    text = lambda k: raw[starts[k] : ends[k]]
    first, which = np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    short = np.flatnonzero(size <= LONG_UNIT)
    first, which[short] = _same_units(data, starts[short], size[short])
    first = short[first]
    long = {}
    for k in np.flatnonzero(size > LONG_UNIT).tolist():
        which[k] = long.setdefault(text(k), len(first) + len(long))
    led = (data[starts[first]] == 0x20) & (size[first] > 1) & _INK_AFTER[data[np.minimum(starts[first] + 1, max(len(data) - 1, 0))]]
    flat, n = _flat([text(k).decode() for k in first[~led].tolist()] + [x.decode() for x in long], path)
    joined, m = _joined(data, starts[first[led]], size[first[led]], path)
    flat, at = np.concatenate([flat, joined]), np.r_[0, np.cumsum(np.r_[n, m])]
    place = np.empty(len(first) + len(long), np.int64)  # of every distinct unit among those encoded
    place[np.r_[np.flatnonzero(~led), len(first) + np.arange(len(long)), np.flatnonzero(led)]] = np.arange(len(place))
    which, n = place[which], np.r_[n, m]
    many = n[which]
    stop = np.cumsum(many)
    every = flat[np.repeat(at[which] - (stop - many), many) + np.arange(stop[-1] if len(stop) else 0)]
    per_text = np.r_[0, stop][np.searchsorted(row, np.arange(len(offs)))]
    once = dict(zip(np.flatnonzero(whole).tolist(), _whole([raw[offs[k] : offs[k + 1]].decode() for k in np.flatnonzero(whole)], path)))
    end = np.array([END_ID], "<u4")
    return [np.concatenate([once[k] if k in once else every[a:b], end]) for k, (a, b) in enumerate(zip(per_text[:-1], per_text[1:]))]


class RoomTree:
    """A tournament tree of bin capacities: each node holds the larger room of its two children."""

    def __init__(self, n: int, room: int):
        self.base = 1 << max(0, n - 1).bit_length()
        self.tree = [room] * (2 * self.base)

    def first_fit(self, size: int) -> int:
        """Takes `size` from the first bin that has it; there are as many bins as items, so one always has."""
        tree, k = self.tree, 1
        while k < self.base:
            k *= 2
            if tree[k] < size:
                k += 1
        tree[k] -= size
        found = k - self.base
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
        return found


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers; sizes must be in decreasing order and at most `length`."""
    tree, bins = RoomTree(len(sizes), length), []
    for i, size in enumerate(sizes):
        b = tree.first_fit(size)
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def _fill(bins: list[list[tuple]], length: int) -> list[list[tuple]]:
    """Fills gaps from the last bins, cutting pieces (doc, start, size); the bin left over is dealt to powers of two."""
    free = [length - sum(p[2] for p in b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if not free[i]:
            i += 1
        elif not bins[j]:
            j -= 1
        else:
            doc, start, size = bins[j].pop()
            take = min(size, free[i])
            bins[i].append((doc, start, take))
            free[i] -= take
            free[j] += take
            if take < size:
                bins[j].append((doc, start + take, size - take))
    bins = [b for b in bins if b]
    if bins and (left := sum(p[2] for p in bins[-1])) < length:
        pieces = bins.pop()
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            bins.append([])
            while want:
                doc, start, size = pieces.pop()
                take = min(size, want)
                bins[-1].append((doc, start, take))
                want -= take
                if take < size:
                    pieces.append((doc, start + take, size - take))
    return bins


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, cut: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece."""
    path = vocabulary or default_vocabulary()

    def group(key, docs):
        docs = docs.take(pc.sort_indices(docs.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        ids = encode(docs.column("text"), path)
        bins = [[(d, s, length)] for d, x in enumerate(ids) for s in range(0, len(x) - length + 1, length)]
        rests = sorted(((len(x) % length, d) for d, x in enumerate(ids) if len(x) % length), key=lambda r: (-r[0], r[1]))
        placed = [[(rests[i][1], len(ids[rests[i][1]]) - rests[i][0], rests[i][0]) for i in b] for b in first_fit_decreasing([r[0] for r in rests], length)]
        bins += _fill(placed, length) if cut else placed
        first = key[0].as_py() << 32
        rows = []
        for b, pieces in enumerate(bins):
            at = 0
            for d, s, n in pieces:
                rows.append((d, s, n, zlib.crc32(ids[d][s : s + n].tobytes()), len(ids[d]), first + b, at))
                at += n
        cols = [np.array(x, dtype=np.int64) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 7
        names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({"doc_id": docs.column("doc_id").combine_chunks().take(pa.array(cols[0])), **dict(zip(names, map(pa.array, cols[1:])))})

    grouped = c.in_groups(docs, c.text_bytes(docs))
    return grouped.groupBy("g").applyInArrow(c.released(group), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
