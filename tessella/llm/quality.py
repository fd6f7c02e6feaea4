"""Operator 6: quality by nearest-neighbour voting over latent-semantic vectors.

1. Terms. A text's terms are shapes, not spellings, so that one model serves all languages: letters of either case,
   digits, white space and every punctuation mark are classes, runs of a class collapse, and 4-grams of classes, whole-word
   shapes, word lengths, and words or lines that repeat earlier ones are counted into `TERMS` hashed columns.
2. Latent semantics. Counts become log(1 + n) * idf, rows are scaled to length one, and a truncated SVD of the labelled
   sample gives `DIM` axes. The sample is the `SAMPLE` labelled rows of smallest xxhash64(doc_id), a documented bound;
   everything else covers all rows.
3. Voting. The labelled vectors (SAMPLE x DIM floats) are sent to all tasks. Every document is scored against all of them
   by exact blocked cosine products; the `NEIGHBOURS` most similar vote with weight max(cosine, 0) ** POWER.

Edge cases: null texts are empty; an empty text has no terms and the score of the labelled rows' mean label, as has any
text without a similar neighbour; a doc_id labelled more than once counts with its mean label, one of several texts with the
smallest; null labels are ignored;
repeated and null doc_ids are scored like any row; with no labelled rows every score is 0.5; neighbours as similar as the
last (to five decimals) all vote; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

SAMPLE = 4000
TERMS = 1024
DIM = 64
NEIGHBOURS = 31
POWER = 4
BLOCK = 1024

_SHAPES = c.Rolling(6)
_WORDS = c.Rolling(66)

#: A class per byte: letters and the bytes of non-ASCII characters, capitals, digits, white space; others as they are.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[[9, 11, 12, 13, 32]] = 32


def _add(out: np.ndarray, row: np.ndarray, column: np.ndarray) -> None:
    out += np.bincount(row * out.shape[1] + column, minlength=out.size).reshape(out.shape).astype(np.float32)


def _seen_before(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(h)), h, row))
    again = np.zeros(len(h), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def term_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of every row's terms."""
    out = np.zeros((len(offs) - 1, TERMS), np.float32)
    if not len(data):
        return out
    grams, words = TERMS // 2, TERMS - TERMS // 2 - 64
    cls = _CLASS[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    at = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]] | edge)
    row = np.searchsorted(offs, at, side="right") - 1
    runs = cls[at].astype(np.uint64)
    if len(at) > 3:
        four = runs[:-3] | runs[1:-2] << np.uint64(8) | runs[2:-1] << np.uint64(16) | runs[3:] << np.uint64(24)
        inside = row[:-3] == row[3:]
        _add(out[:, :], row[:-3][inside], (c.mix(four[inside]) % np.uint64(grams)).astype(np.int64))
    s, e, first = c.words(data, offs)
    if not len(s):
        return out
    wrow = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begins = np.zeros(len(data), bool)
    begins[at] = True
    sums = _SHAPES.sums(np.where(begins, _SHAPES.code[cls], np.uint64(0)))
    shape = (sums[e] - sums[s]) * _SHAPES.down[s]
    _add(out, wrow, grams + (c.mix(shape) % np.uint64(words)).astype(np.int64))
    same = c.word_hashes(data, s, e, _WORDS)
    base = TERMS - 64
    length = np.minimum(e - s, 31)
    _add(out, wrow, base + length)
    twice = np.r_[False, (same[1:] == same[:-1]) & (wrow[1:] == wrow[:-1])]  # a text's first word counts as new, wherever the text lies
    _add(out, wrow, base + 32 + twice)
    _add(out, wrow, base + 34 + _seen_before(wrow, same))
    # lines that came before in the same text
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.r_[offs[:-1], ends + 1])
    starts = starts[starts < len(data)]
    stops = np.r_[starts[1:], len(data)]
    lrow = np.searchsorted(offs, starts, side="right") - 1
    line = _WORDS.slices(_WORDS.sums(_WORDS.code[data]), starts, stops)
    _add(out, lrow, base + 36 + _seen_before(lrow, line))
    return out


class Model:
    """Axes, idf, and the labelled sample's vectors and labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dim: int = DIM):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self._weighted(counts)
        _, axes = np.linalg.eigh(x.T @ x)  # right singular vectors
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :dim]).astype(np.float32)
        self.vectors = self.project(counts)

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = self._weighted(counts) @ self.axes
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        if not len(self.labels):
            return out
        v, k = self.project(counts), min(k, len(self.labels))
        for a in range(0, len(v), BLOCK):
            cosine = v[a : a + BLOCK] @ self.vectors.T
            np.round(cosine, 5, out=cosine)  # so that how rows fall into batches never breaks a tie
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k]
            row, near = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
            w = cosine[row, near].astype(np.float64) ** power
            total = np.bincount(row, weights=w, minlength=len(cosine))
            good = np.bincount(row, weights=w * self.labels[near], minlength=len(cosine))
            some = (total > 1e-9) & (counts[a : a + BLOCK].sum(axis=1) > 0)
            out[a : a + BLOCK][some] = np.clip(good[some] / total[some], 0, 1)
        return out


def _each(batch: pa.RecordBatch):
    """Row ranges of a batch and their term counts, a bounded number of rows at a time."""
    data, offs = c.utf8(batch.column("text"))
    for a, b in c.chunks(offs):
        for x in range(a, b, BLOCK):
            y = min(b, x + BLOCK)
            yield x, y, term_counts(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: (doc_id, text); labels: (doc_id, label) of rows that may be learned from."""
    labels = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # `sample` rows at most: small enough to send

    def f(batches):
        for batch in batches:
            for a, b, counts in _each(batch):
                terms = [np.flatnonzero(x) for x in counts]
                raw = [[t.astype(np.uint16).tobytes() for t in terms], [x[t].tobytes() for x, t in zip(counts, terms)]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("label")[a:b], *(pa.array(x, pa.binary()) for x in raw)], ["doc_id", "label", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(f, "doc_id long, label double, terms binary, counts binary").toArrow().sort_by("doc_id")
    counts = np.zeros((len(got), TERMS), np.float32)
    for k, (t, x) in enumerate(zip(got.column("terms").to_pylist(), got.column("counts").to_pylist())):
        counts[k, np.frombuffer(t, np.uint16)] = np.frombuffer(x, np.float32)
    return Model(counts, got.column("label").to_numpy())


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name (double, 0 to 1) added last."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def f(batches):
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(where)], ["text"])
            s = [sent.value.scores(counts) for _, _, counts in _each(one)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(s) if s else np.zeros(0))], names)

    names = [*docs.columns, name]
    return docs.mapInArrow(f, docs.select("*", F.lit(0.0).alias(name)).schema)


def learnable(labels: DataFrame, label: str = "quality") -> DataFrame:
    """Labelled rows outside the held-out third."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
