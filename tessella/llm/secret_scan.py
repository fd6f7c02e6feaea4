"""Secret scans: three patterns, and a linear-chain conditional random field that finds what is written like their matches.

Patterns (kind, what counts): `assign`, the value of a named setting, of 6 characters or more; `access`, an access key id of
20 or more; `hex`, a run of 24 or more hex digits. Each kind's matches are leftmost and do not overlap.

The field tags tokens (runs of letters, digits, _ - + / and characters beyond ASCII) as secret begin, inside or outside. Its
features are a token's length, alphabet and changes of alphabet, the signs before and after it, the words around it (hashed),
their alphabets, and the file's share of digits and of = and :. It learns from windows of at most WINDOW tokens of `sample`
documents that hold a pattern's match and as many that hold none, chosen by a hash of the text; the matches are the labels,
and every other window hides what surrounds its tokens, so that shape has to tell. Nothing but the windows is gathered.

Decoding is exact: where outside leads by more than any two transitions can give back, the best path is outside there, so
Viterbi runs only between such tokens. Long documents are scored in slices of tokens with two neighbours at each side.
A found span that touches a pattern's match is left out; the others are kind `crf`.

Null texts are empty, bytes that are no UTF-8 read as U+FFFD; an empty text has no spans; repeated rows and null ids are scanned row by row; an empty table, or one
without matches to learn from, gives the patterns' spans alone. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, kept, utf8, word_hashes

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile("AKIA[A-Z0-9]{16,}"), re.compile("[0-9a-f]{24,}")

SAMPLE, WINDOW, ROUNDS = 1500, 24, 60
SLICE = 1 << 16
O, B, I = 0, 1, 2

_DIGIT, _LOWER, _UPPER, _SIGN, _WIDE, _NOT_HEX = 1, 2, 4, 8, 16, 32
_BITS = np.zeros(256, np.uint8)
_BITS[0x30:0x3A], _BITS[0x61:0x7B], _BITS[0x41:0x5B], _BITS[0x80:] = _DIGIT, _LOWER, _UPPER, _WIDE
_BITS[[ord(x) for x in "_-+/"]] = _SIGN
_TOKEN = _BITS > 0
_BITS[[x for x in range(256) if _BITS[x] and chr(x) not in "0123456789abcdef"]] |= _NOT_HEX
_SEPARATOR = np.full(256, 64, np.uint8)
for _i, _signs in enumerate(("=", ":", "\"'`", "\r\n", ".", " \t")):
    _SEPARATOR[[ord(x) for x in _signs]] = 1 << _i
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_LENGTHS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_CHANGES = np.array([1, 2, 3, 5, 8, 13])
_WORDS = 1 << 12
_ROLL = Rolling(12)

#: how many values each feature takes; features 4 to 10 look around the token, their last value is `hidden`
SIZES = [13, 64, 5 * 13, 7, 130, 130, _WORDS + 2, _WORDS + 2, _WORDS + 2, 67, 34, 24]
FIRST = np.r_[0, np.cumsum(SIZES)[:-1]].astype(np.int32)
AROUND = range(4, 11)


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) in code points, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(1), 0, m.end(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and each row's first token (one more at the end)."""
    ink = np.zeros(len(data) + 2, dtype=bool)
    ink[1:-1] = _TOKEN[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    starts = np.flatnonzero(ink[1:] & (~ink[:-1] | edge))
    ends = np.flatnonzero(ink[:-1] & (~ink[1:] | edge))
    return starts, ends, np.searchsorted(starts, offs)


def file_code(data: np.ndarray) -> int:
    """The file's share of digits (6 steps) and of = and : (4 steps)."""
    n = max(1, len(data))
    digits = marks = 0
    for a in range(0, len(data), 1 << 20):
        part = data[a : a + (1 << 20)]
        digits += int(np.count_nonzero((part >= 0x30) & (part <= 0x39)))
        marks += int(np.count_nonzero((part == 0x3D) | (part == 0x3A)))
    return int(np.searchsorted([0.001, 0.01, 0.03, 0.1, 0.3], digits / n)) * 4 + int(np.searchsorted([0.0005, 0.005, 0.02], marks / n))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For tokens in order, the numbers of their features (one column each), counted on from FIRST."""
    n, lo = len(starts), starts[0]
    part = data[lo : ends[-1]]
    at = np.empty(2 * n, np.int64)
    at[::2], at[1::2] = starts - lo, ends - lo
    at = at[:-1]
    bits = np.bitwise_or.reduceat(_BITS[part], at)[::2]
    between = np.bitwise_or.reduceat(_SEPARATOR[part], at)[1::2]
    turn = np.zeros(len(part), np.int32)
    kind = _BITS[part] & 31
    turn[1:] = kind[1:] != kind[:-1]
    changes = np.add.reduceat(turn, at)[::2] - turn[at[::2]]
    length = ends - starts
    size = np.searchsorted(_LENGTHS, length, side="right")
    hexes = (bits & (_NOT_HEX | _DIGIT | _LOWER)) == _DIGIT | _LOWER
    alphabet = bits & 31
    mixed = np.select([hexes, alphabet == (_DIGIT | _UPPER), alphabet == _DIGIT, (alphabet & 7) == 7], [1, 2, 3, 4], 0)
    word = (word_hashes(_LOW[part], at[::2], np.r_[at[1::2], len(part)], _ROLL) >> np.uint64(40)).astype(np.int64) % _WORDS

    same = doc[1:] == doc[:-1]

    def shifted(values, by, edge):
        out = np.full(n, edge, np.int64)
        if by < 0:
            out[1:][same] = values[:-1][same]
        else:
            out[:-1][same] = values[1:][same]
        return out

    gap = np.r_[between, 0].astype(np.int64)  # what follows a token
    before, after = shifted(gap, -1, 128), np.where(np.r_[same, False], gap, 128)
    previous = shifted(word, -1, _WORDS)
    named = (before < 128) & ((before & 3) > 0)
    return np.stack([
        size, alphabet + 32 * hexes, mixed * 13 + size, np.searchsorted(_CHANGES, changes, side="right"), before, after,
        previous, shifted(previous, -1, _WORDS), shifted(word, 1, _WORDS), shifted(alphabet, -1, 32) * 2 + named, shifted(alphabet, 1, 32), code,
    ], axis=1).astype(np.int32) + FIRST


def _valid(text: pa.Array) -> pa.Array:
    """text with U+FFFD for bytes that are no UTF-8, which a string of Spark's may hold."""
    try:
        text.validate(full=True)
        return text
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode(errors="replace") for x in text.cast(pa.large_binary()).to_pylist()], pa.large_string())


def _sample(size: int):
    def run(batches):
        least: dict[bool, list] = {True: [], False: []}  # the least hashes, negated, of documents with and without a match
        known = set()
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), _valid(batch.column("text")).to_pylist()):
                if h in known or not text or all(len(x) == size and -x[0][0] <= h for x in least.values()):
                    continue
                spans = pattern_spans(text)
                heap = least[bool(spans)]
                if len(heap) == size and -heap[0][0] <= h:
                    continue
                window = _window(text, spans, h)
                if window:
                    known.add(h)
                    gone = heapq.heappushpop(heap, (-h, window)) if len(heap) == size else heapq.heappush(heap, (-h, window))
                    if gone:
                        known.discard(-gone[0])
        for found, heap in least.items():
            if heap:
                h, x, y = zip(*[(-h, x, y) for h, (x, y) in heap])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([found] * len(h)), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["h", "found", "x", "y"])

    return run


def _window(text: str, spans: list, h: int) -> tuple[bytes, bytes] | None:
    """Features and labels of at most WINDOW tokens, about one of the matches or, without any, about a place that h names."""
    at, _, end = spans[h % len(spans)] if spans else (h % max(1, len(text)), 0, 0)
    left = max(0, at - 6 * WINDOW)
    piece = text[left : max(end, at) + 6 * WINDOW]
    raw = np.frombuffer(piece.encode(), np.uint8)
    starts, ends, _ = tokens(raw, np.array([0, len(raw)]))
    if not len(starts):
        return None
    x = features(raw, starts, ends, np.zeros(len(starts), int), np.full(len(starts), file_code(np.frombuffer(text.encode(), np.uint8))))
    byte_at = np.r_[0, np.cumsum([len(c.encode()) for c in piece])]
    y = np.zeros(len(starts), np.uint8)
    for s, _, e in spans:
        if s < left + len(piece) and e > left:
            a, b = byte_at[max(0, s - left)], byte_at[min(len(piece), e - left)]
            inside = np.flatnonzero((ends > a) & (starts < b))
            y[inside] = I
            y[inside[:1]] = B
    first = max(0, int(np.searchsorted(starts, byte_at[at - left])) - WINDOW // 2)
    x, y = x[first : first + WINDOW], y[first : first + WINDOW]
    if h & 1:
        for f in AROUND:
            x[:, f] = FIRST[f] + SIZES[f] - 1
    return x.astype(np.int32).tobytes(), y.tobytes()


def _best(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(scores - top).sum(axis=axis))


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions of greatest penalised likelihood, by Adam over all windows at once."""
    n, most, k = len(windows), max(len(y) for _, y in windows), len(SIZES)
    x, y, here = np.zeros((n, most, k), np.int64), np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (fx, fy) in enumerate(windows):
        x[i, : len(fy)], y[i, : len(fy)], here[i, : len(fy)] = fx, fy, True
    w, a = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    flat, total = x[here], here.sum()
    step = [np.zeros_like(z) for z in (w, w, a, a)]
    for t in range(1, rounds + 1):
        u = w[x].sum(axis=2)
        f, b = np.empty((n, most, 3)), np.zeros((n, most, 3))
        f[:, 0] = u[:, 0]
        for j in range(1, most):
            f[:, j] = np.where(here[:, j, None], u[:, j] + _best(f[:, j - 1, :, None] + a, 1), f[:, j - 1])
        z = _best(f[:, -1], 1)
        for j in range(most - 2, -1, -1):
            b[:, j] = np.where(here[:, j + 1, None], _best(a + (u[:, j + 1] + b[:, j + 1])[:, None, :], 2), 0)
        p = np.exp(f + b - z[:, None, None])
        p[np.arange(n)[:, None], np.arange(most), y] -= 1
        error = p[here]
        gw = np.stack([np.bincount(flat.ravel(), np.repeat(error[:, s], k), minlength=len(w)) for s in range(3)], axis=1) / total + decay * w
        both = here[:, 1:]
        pair = np.exp(f[:, :-1, :, None] + a + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])[both].sum(0)
        np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), -1)
        for v, g, m, s in ((w, gw, step[0], step[1]), (a, pair / total + decay * a, step[2], step[3])):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return w, a


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """The field's weights and transitions, from at most 2 * sample windows; None where no document holds a match."""
    hashed = docs.select(F.xxhash64("text").bitwiseAND((1 << 62) - 1).alias("h"), "text").where("text <> ''")
    found = kept(hashed.mapInArrow(_sample(sample), "h long, found boolean, x binary, y binary").dropDuplicates(["h"]))
    rows = [r for flag in (True, False) for r in found.where(F.col("found") == flag).orderBy("h").limit(sample).collect()]
    if not any(r.found for r in rows):
        return None
    return train([(np.frombuffer(r.x, np.int32).reshape(-1, len(SIZES)), np.frombuffer(r.y, np.uint8)) for r in rows])


def margin(a: np.ndarray) -> float:
    """The most that two transitions can speak for begin or inside at a token, against outside."""
    return max(0.0, *(a[i, s] + a[s, j] - a[i, O] - a[O, j] for i in range(3) for j in range(3) for s in (B, I)), *(max(a[:, s] - a[:, O]) for s in (B, I)), *(max(a[s] - a[O]) for s in (B, I)))


def viterbi(u: np.ndarray, a: np.ndarray, left: bool, right: bool) -> list[int]:
    """The best labels of tokens scored u; left, right: a token outside comes before, after. Ties go to the earlier label."""
    step, trans = [], a.tolist()
    scores = u.tolist()
    v = [x + (trans[O][s] if left else 0.0) for s, x in enumerate(scores[0])]
    for row in scores[1:]:
        came = [max(range(3), key=lambda i, s=s: v[i] + trans[i][s]) for s in range(3)]
        v = [v[came[s]] + trans[came[s]][s] + row[s] for s in range(3)]
        step.append(came)
    if right:
        v = [x + trans[s][O] for s, x in enumerate(v)]
    out = [max(range(3), key=v.__getitem__)]
    for came in reversed(step):
        out.append(came[out[-1]])
    return out[::-1]


def labels(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, codes: np.ndarray, model, slice_tokens: int = SLICE) -> np.ndarray:
    """A label for every token. codes: each document's file_code."""
    w, a = model
    n = len(starts)
    u = np.empty((n, 3), np.float32)
    for i in range(0, n, slice_tokens):
        lo, hi = max(0, i - 2), min(n, i + slice_tokens + 2)
        x = features(data, starts[lo:hi], ends[lo:hi], doc[lo:hi], codes[doc[lo:hi]])[i - lo : i - lo + slice_tokens]
        u[i : i + slice_tokens] = sum(w[x[:, f]] for f in range(x.shape[1]))
    out = np.zeros(n, np.uint8)
    open_ = np.flatnonzero(u[:, O] - u[:, 1:].max(axis=1) <= margin(a) + 1e-3)
    for run in np.split(open_, np.flatnonzero((np.diff(open_) > 1) | (doc[open_[1:]] != doc[open_[:-1]])) + 1) if len(open_) else []:
        i, j = run[0], run[-1]
        out[i : j + 1] = viterbi(u[i : j + 1].astype(float), a, i > 0 and doc[i - 1] == doc[i], j + 1 < n and doc[j + 1] == doc[j])
    return out


def field_spans(data: np.ndarray, offs: np.ndarray, model) -> dict[int, list[tuple[int, int]]]:
    """Row -> spans in bytes that the field tags, for the rows that have any."""
    out: dict[int, list] = {}
    for r0, r1 in chunks(offs):
        part, rows = data[offs[r0] : offs[r1]], offs[r0 : r1 + 1] - offs[r0]
        starts, ends, first = tokens(part, rows)
        if not len(starts):
            continue
        doc = np.repeat(np.arange(r1 - r0), np.diff(first))
        codes = np.array([file_code(part[x:y]) for x, y in zip(rows, rows[1:])])
        tags = labels(part, starts, ends, doc, codes, model)
        begun = None
        for t in np.flatnonzero(tags):
            row = r0 + int(doc[t])
            if begun == (row, t - 1) and tags[t] == I:
                out[row][-1] = (out[row][-1][0], int(ends[t] - rows[doc[t]]))
            else:
                out.setdefault(row, []).append((int(starts[t] - rows[doc[t]]), int(ends[t] - rows[doc[t]])))
            begun = (row, t)
    return out


def _scan(model):
    def run(batches):
        for batch in batches:
            text = _valid(batch.column("text"))
            data, offs = utf8(text)
            tagged = field_spans(data, offs, model) if model else {}
            rows = []
            for i, t in enumerate(text.to_pylist()):
                spans = pattern_spans(t) if t else []
                if i in tagged:
                    chars = np.r_[0, np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80)]
                    own = [(int(chars[a]), 3, int(chars[b])) for a, b in tagged[i]]
                    spans = sorted(spans + [x for x in own if not any(x[0] < e and s < x[2] for s, _, e in spans)])
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    return run


def secret_spans(docs: DataFrame, model) -> DataFrame:
    """(doc_id, spans): of every row, (kind, start, end) in code points, end exclusive, by start and then kind as in KINDS."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(_scan(model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of each pattern's spans, the SHA-256 of all of them, and every span as text."""
    told = lambda only: F.array_join(F.transform(only, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return spans.select("doc_id", *[count(x) for x in KINDS[:3]], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
