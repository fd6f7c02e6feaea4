"""Operator 5: benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared as bytes after lower-casing A-Z and turning runs of white space into one blank. An item of
m bytes counts as found if some part of a text is within e = floor(rate * m) edits of it. Such a part shares at least
m - q + 1 - q * e of the item's q-grams, all on diagonals within e of one another, so

1. every q-gram of every text (8 bytes, read as one integer) is looked up among the items' q-grams, by a bit table first;
2. hits are counted in diagonal bands of width 2w that overlap by w > e, so every such part lies in one band. The lemma
   stays exact when some q-grams of an item are left out and its count is lowered by as many: the ones that other items
   share are left out first, down to `q * e + SPARE`;
3. bands that meet the count are verified by banded alignment, free at both ends of the text: for k = 0, 1, ... edits every
   diagonal of the band keeps how far into the item it gets, and equal bytes are run through eight at a time. A find of k
   edits costs k rounds, an exact copy none; batches are bounded by their cells, whatever an item's length.

Items under `EXACT_BYTES` normalised bytes count only as exact whole words (no letter or digit beside them), and those under
`Q` bytes only where they are a whole text. The benchmark is the stated query set. It is compiled and sent to all tasks in
slices of about `SLICE_BYTES`, each of which all texts are held against: compiled, a slice takes some 140 times its bytes in every
task, so 1 MB keeps that under 150 MB.

Edge cases: null and empty texts give no rows; null and blank items take no part; equal items match under each item_id; null
ids are kept; overlapping finds of one item in one text are one row with the smallest distance; repeated rows are rows each;
empty tables give empty results.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

Q = 8
RATE = 0.1
SPARE = 24
EXACT_BYTES = 40
SLICE_BYTES = 1 << 20
CELLS = 1 << 17
TABLE_BITS = 22

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, each row's offset there, and every byte's place in the original."""
    low = _LOWER[data]
    blank = low == 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    keep = ~(blank & np.r_[False, blank[:-1]] & ~edge[:-1]) if len(low) else np.zeros(0, bool)
    at = np.flatnonzero(keep)
    return low[at], np.searchsorted(at, offs), at


def grams(data: np.ndarray) -> np.ndarray:
    n = len(data) - Q + 1
    return np.lib.stride_tricks.sliding_window_view(data, Q).copy().view("<u8").ravel() if n > 0 else np.zeros(0, np.uint64)


class Items:
    """The compiled benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE):
        self.ids, self.text, self.edits, self.need, self.tiny = [], [], [], [], {}
        for i, t in items:
            raw = np.frombuffer((t or "").strip().encode(), np.uint8)
            x = normalised(raw, np.array([0, len(raw)]))[0]
            if len(x):
                if len(x) < Q:
                    self.tiny.setdefault(x.tobytes(), []).append(len(self.ids))
                self.ids.append(i)
                self.text.append(x)
                self.edits.append(min(int(rate * len(x)), (len(x) - Q) // Q) if len(x) >= EXACT_BYTES else 0)
        every = [grams(x) for x in self.text]
        distinct, share = np.unique(np.concatenate([np.unique(x) for x in every]), return_counts=True) if every else (np.zeros(0, np.uint64),) * 2
        g, i, j = [], [], []
        for k, x in enumerate(every):
            keep = min(len(x), Q * self.edits[k] + SPARE)
            self.need.append(keep - Q * self.edits[k])
            at = np.sort(np.argsort(share[np.searchsorted(distinct, x)], kind="stable")[:keep])
            g.append(x[at]), i.append(np.full(keep, k)), j.append(at)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        g, i, j = cat(g, np.uint64), cat(i, np.int64), cat(j, np.int64)
        order = np.argsort(g, kind="stable")
        self.gram, self.item, self.place = g[order], i[order], j[order]
        self.uniq, self.first, self.count = np.unique(self.gram, return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.uniq * _SPREAD >> np.uint64(64 - TABLE_BITS)] = True
        self.edits, self.need = np.array(self.edits, np.int64), np.array(self.need, np.int64)
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.flat = np.concatenate([*self.text, np.zeros(8, np.uint8)])

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, item, place in the item) of every shared q-gram."""
        x = grams(data)
        p = np.flatnonzero(self.table[x * _SPREAD >> np.uint64(64 - TABLE_BITS)])
        k = np.searchsorted(self.uniq, x[p])
        same = self.uniq[np.minimum(k, len(self.uniq) - 1)] == x[p] if len(self.uniq) else np.zeros(len(p), bool)
        p, k = p[same], k[same]
        n = self.count[k]
        end = np.cumsum(n)
        at = np.repeat(self.first[k] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
        return np.repeat(p, n), self.item[at], self.place[at]

    def bands(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, lowest diagonal) of the bands that meet the bound. Diagonals count from the start of `data`."""
        p, i, j = self.hits(data)
        row = np.searchsorted(offs, p, side="right") - 1
        fits = p + Q <= offs[row + 1]
        p, i, j, row = p[fits], i[fits], j[fits], row[fits]
        alone = self.edits[i] == 0  # without edits a shared q-gram tells the very place
        exact = np.unique(np.stack([row[alone], i[alone], (p - j)[alone]], axis=1), axis=0) if alone.any() else np.zeros((0, 3), np.int64)
        p, i, j, row = p[~alone], i[~alone], j[~alone], row[~alone]
        width = self.edits[i] + 1
        band = (p - j) // width
        # sort once by (row, item, band); a band and the next make one of width 2w
        order = np.lexsort((band, i, row))
        row, i, band = row[order], i[order], band[order]
        if not len(row):
            return tuple(exact.T)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (i[1:] != i[:-1]) | (band[1:] != band[:-1])])
        n = np.diff(np.r_[new, len(row)])
        row, i, band = row[new], i[new], band[new]
        follows = np.r_[(row[1:] == row[:-1]) & (i[1:] == i[:-1]) & (band[1:] == band[:-1] + 1), False]
        both = n + np.where(follows, np.r_[n[1:], 0], 0)
        preceded = np.r_[False, follows[:-1]]
        a = np.flatnonzero(both >= self.need[i])
        b = np.flatnonzero((n >= self.need[i]) & ~preceded)  # a band that no lower one joins
        at, low = np.r_[a, b], np.r_[band[a], band[b] - 1]
        return tuple(np.concatenate([np.stack([row[at], i[at], low * (self.edits[i[at]] + 1)], axis=1), exact]).T)

    def verify(self, data: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray):
        """Best distance and [start, end) within the texts, for every band; those over the budget have distance -1."""
        best, start, end = np.full(len(row), -1, np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        text = np.r_[data, np.zeros(8, np.uint8)]
        order = np.argsort(self.edits[item], kind="stable")
        width = np.where(self.edits[item] > 0, 4 * self.edits[item] + 3, 1)[order]
        a = 0
        while a < len(order):  # bands of like width; as many as the cells allow
            b = a + 1
            while b < len(order) and width[b] * (b + 1 - a) <= CELLS and width[b] <= 2 * width[a] + 8:
                b += 1
            x = order[a:b]
            best[x], start[x], end[x] = self._align(text, offs[row[x]], offs[row[x] + 1], item[x], low[x], int(width[b - 1]))
            a = b
        return best, start, end

    def _run(self, text: np.ndarray, at: np.ndarray, item_at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal bytes of the text and the items from these places on, at most `most`."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        if not len(live):
            return out
        word = lambda x: np.lib.stride_tricks.sliding_window_view(x, 8)
        t, i = word(text), word(self.flat)
        while len(live):
            x = t[at[live] + out[live]].view("<u8").ravel() ^ i[item_at[live] + out[live]].view("<u8").ravel()
            same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) // 8)
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def _align(self, text, lo, hi, item, low, width):
        """Furthest-reaching alignment: `far` is how much of the item each diagonal covers with k edits, `origin` where it began."""
        m, e, first = self.size[item], self.edits[item], self.at[item]
        best, start, end = np.full(len(item), -1, np.int64), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        live, none = np.arange(len(item)), -(1 << 40)
        diag = (low - e)[:, None] + np.arange(width)[None, :]
        far = np.where((diag >= lo[:, None]) & (diag <= hi[:, None]), 0, none)
        origin = diag.copy()
        k = 0
        while True:
            c_, w = np.nonzero(far >= 0)
            done = far[c_, w]
            at, of = diag[c_, w] + done, live[c_]
            far[c_, w] += self._run(text, at, first[of] + done, np.minimum(m[of] - done, hi[of] - at))
            whole = far >= m[live, None]
            met = whole.any(axis=1)
            w = whole[met].argmax(axis=1)
            best[live[met]], start[live[met]] = k, origin[met, w]
            end[live[met]] = diag[met, w] + m[live[met]]
            k += 1
            stay = ~met & (e[live] >= k)
            if not stay.any():
                return best, start, end
            live, diag, far, origin = live[stay], diag[stay], far[stay], origin[stay]
            pad = np.full((len(live), 1), none)
            away = np.zeros((len(live), 1), np.int64)
            room = hi[live, None] - diag  # no diagonal goes past its text
            swap = np.where(far + 1 <= room, far + 1, none)
            drop, drop_from = np.concatenate([far[:, 1:] + 1, pad], axis=1), np.concatenate([origin[:, 1:], away], axis=1)
            more, more_from = np.concatenate([pad, far[:, :-1]], axis=1), np.concatenate([away, origin[:, :-1]], axis=1)
            more = np.where(more <= room, more, none)
            new, origin = np.where(drop > swap, drop, swap), np.where(drop > swap, drop_from, origin)
            far, origin = np.where(more > new, more, new), np.where(more > new, more_from, origin)
            far = np.where(far < 0, none, np.minimum(far, m[live, None]))


def slices(benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE_BYTES):
    """The benchmark compiled in slices of about `slice_bytes` of text, each broadcast."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("trim(text) <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = -(-size // slice_bytes)
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield spark.sparkContext.broadcast(Items([tuple(r) for r in mine.collect()], rate))


def found_in(items: Items, data: np.ndarray, offs: np.ndarray):
    """(row, item, start, end, distance): finds in one chunk of rows, in bytes from each row's start; overlapping ones merged."""
    norm, noffs, at = normalised(data, offs)
    row, item, low = items.bands(norm, noffs)
    best, start, end = items.verify(norm, noffs, row, item, low)
    ok = best >= 0
    small = np.flatnonzero(ok & (items.size[item] < EXACT_BYTES))
    if len(small):  # whole words only
        a, b, r = start[small], end[small], row[small]
        ok[small] = ~(((a > noffs[r]) & _WORD[norm[np.maximum(a - 1, 0)]]) | ((b < noffs[r + 1]) & _WORD[norm[np.minimum(b, len(norm) - 1)]]))
    if items.tiny:
        found = []
        for r in np.flatnonzero(np.diff(noffs) <= Q + 2).tolist():
            raw = norm[noffs[r] : noffs[r + 1]].tobytes()
            s = noffs[r] + len(raw) - len(raw.lstrip())
            found += [(r, i, s, s + len(raw.strip()), 0) for i in items.tiny.get(raw.strip(), [])]
        r, i, s, e, d = np.array(found, np.int64).reshape(-1, 5).T
        row, item, start, end, best, ok = np.r_[row, r], np.r_[item, i], np.r_[start, s], np.r_[end, e], np.r_[best, d], np.r_[ok, np.ones(len(r), bool)]
    row, item, best, start, end = row[ok], item[ok], best[ok], start[ok], end[ok]
    order = np.lexsort((best, end, start, item, row))
    out = []
    for k in order:
        one = [int(row[k]), int(item[k]), int(start[k]), int(end[k]), int(best[k])]
        if out and out[-1][:2] == one[:2] and one[2] < out[-1][3]:
            if one[4] < out[-1][4]:
                out[-1] = one
        else:
            out.append(one)
    place = np.r_[at, len(data)]
    return [(r, i, int(place[s] - offs[r]), int((place[e - 1] + 1 if e > s else place[s]) - offs[r]), d) for r, i, s, e, d in out]


SCHEMA = "doc_id long, item_id long, start long, length long, distance long"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, item_id, start, length, distance) of every find; start and length in bytes of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def finds(items):
        def f(batches):
            it = items.value
            for batch in batches:
                ids, (data, offs) = batch.column("doc_id"), c.utf8(batch.column("text"))
                for a, b in c.chunks(offs):
                    found = found_in(it, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                    if found:
                        r, i, s, e, d = map(np.array, zip(*found))
                        named = pa.array([it.ids[x] for x in i], pa.int64())
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + a)), named, pa.array(s), pa.array(e - s), pa.array(d)], ["doc_id", "item_id", "start", "length", "distance"])

        return rows.mapInArrow(f, SCHEMA)

    out = [finds(x) for x in slices(benchmark, rate, slice_bytes)]
    return functools.reduce(DataFrame.unionAll, out) if out else docs.sparkSession.createDataFrame([], SCHEMA)


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs in which no item is found, all columns unchanged."""
    where = docs.columns.index("text")

    def without(docs, items):
        def f(batches):
            it = items.value
            for batch in batches:
                data, offs = c.utf8(batch.column(where))
                keep = np.ones(len(batch), bool)
                for a, b in c.chunks(offs):
                    for r, *_ in found_in(it, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]):
                        keep[a + r] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(f, docs.schema)

    return functools.reduce(without, slices(benchmark, rate, slice_bytes), docs)
