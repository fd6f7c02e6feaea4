"""Ids of texts cut into units against ids of whole texts, and the whole result of packing against its contract."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import packing

ALPHABET = list(" \t\n\r\x0b\x0c\x1c\x85'aZ9.,-_<|>\"(é×÷ß") + ["\u00a0", "\u1680", "\u2003", "\u3000", "中", "я", "Ѣ", "😀", "\u0301", "²", "ª", "'s", "'ll", "  ", "\n\n", " the", "word", "١", "ǅ", "\ufeff"]


@pytest.mark.parametrize("seed", range(6))
def test_units_give_the_ids_of_whole_texts(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", None, "x" * 700, " " * 300, "a " * 500, "<|endoftext|>", "foo  <|endoftext|>  bar", " a" * 3 + "\n", "中" * 400]
    got = packing.encode(pa.array(texts), packing.default_vocabulary())
    hf = packing._tokenizer(packing.default_vocabulary())
    for t, x in zip(texts, got):
        assert x.tolist() == [*hf.encode(t or "", add_special_tokens=False).ids, packing.END_ID], repr(t)


def test_units_met_by_equal_digests_stay_apart(monkeypatch):
    monkeypatch.setattr(packing.c, "mix", lambda x: x * np.uint64(0))
    data = np.frombuffer(b"abcdefghij" * 2, np.uint8)
    first, which = packing._same_units(data, np.array([0, 10, 2, 12, 5]), np.array([2, 2, 2, 2, 3]))
    spell = [data[s : s + n].tobytes() for s, n in zip([0, 10, 2, 12, 5], [2, 2, 2, 2, 3])]
    assert [spell[first[w]] for w in which] == spell


def test_every_id_lies_in_one_piece(spark):
    rows = [(1, "word " * 3000), (1, "word " * 3000), (None, "null id"), (2, None), (3, ""), (4, "é" * 5000), (5, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = packing.default_vocabulary()
    want = collections.Counter((i, *x.tolist()) for (i, t), x in zip(rows, packing.encode(pa.array([t for _, t in rows]), path)))
    pieces = collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        pieces[r.doc_id, r.doc_tokens].append(r)
    for (doc, n, *ids) in {(x[0], len(x) - 1, *x[1:]) for x in want}:
        mine = pieces[doc, n]
        ids = np.array(ids, "<u4")
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
        times = np.zeros(n, int)
        for r in mine:
            times[r.start : r.start + r.length] += 1
        assert (times == want[(doc, *ids.tolist())]).all()
