"""The patterns against regular expressions, Viterbi against all paths, and the field against held-out and planted secrets."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import queries, secret_scan
from tessella.llm.common import table, utf8

from ..conftest import DATA

LARGE = DATA.replace("sf0.01", "sf0.1")


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, LARGE, "documents").where("doc_id % 2 = 0")
    return secret_scan.fit(docs)


def plain(text):
    found = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(2), 0, m.end(2)))
    for k, p, n in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[0]) >= n]
    return sorted(found)


def test_patterns():
    rng = random.Random(2)
    parts = ["token", "Password", "API_KEY", "apikey", "ſecret", "secret", "=", ":", " = ", '"', "'", "abc", "abcdef1", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "日", "\n", " ", "..", "===="]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=12))
        assert secret_scan.pattern_spans(text) == plain(text)


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = rng.integers(1, 6)
        u, a, left, right = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), *rng.integers(0, 2, 2).astype(bool)

        def worth(path):
            s = sum(u[i, y] for i, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:]))
            return s + (a[0, path[0]] if left else 0) + (a[path[-1], 0] if right else 0)

        assert tuple(secret_scan.viterbi(u, a, left, right)) == max(itertools.product(range(3), repeat=n), key=worth)


def test_shortcut_and_slices_change_nothing(model, monkeypatch):
    rng = random.Random(6)
    words = ["alpha", "key", "=", ": ", '"', "\n", " ", "9f8e7d6c5b4a3210ffee", "Zx81kQ0pLm33", "2024", "der", "é", "token", "."]
    data, offs = utf8(__import__("pyarrow").array(["".join(rng.choices(words, k=rng.randrange(90))) for _ in range(40)] + [None, ""]))
    starts, ends, first = secret_scan.tokens(data, offs)
    doc, codes = np.repeat(np.arange(len(offs) - 1), np.diff(first)), np.arange(len(offs) - 1) % 24
    want = secret_scan.labels(data, starts, ends, doc, codes, model)
    assert (secret_scan.labels(data, starts, ends, doc, codes, model, 7) == want).all() and want.any()
    monkeypatch.setattr(secret_scan, "margin", lambda a: np.inf)
    assert (secret_scan.labels(data, starts, ends, doc, codes, model) == want).all()


def test_field_finds_held_out_matches_and_new_forms(spark, model):
    rows = table(spark, LARGE, "documents").where("doc_id % 2 = 1 AND text IS NOT NULL").toPandas()
    data, offs = utf8(__import__("pyarrow").array(rows.text))
    tagged = secret_scan.field_spans(data, offs, model)
    spans = {i: s for i, s in enumerate(map(secret_scan.pattern_spans, rows.text)) if s}
    assert sum(i in tagged for i in spans) >= 0.95 * len(spans) and len(spans) > 10
    assert sum(i not in spans for i in tagged) <= 0.01 * len(rows)  # documents without a match are left alone
    rng = random.Random(8)
    hidden = ["".join(rng.choices("0123456789abcdef", k=20)) for _ in range(40)]
    planted = [f"{rows.text[i % len(rows)][:200]} credential = \"{x}\" {rows.text[i % len(rows)][:200]}" for i, x in enumerate(hidden)]
    assert not any(secret_scan.pattern_spans(f'credential = "{x}"') for x in hidden)
    data, offs = utf8(__import__("pyarrow").array(planted))
    tagged = secret_scan.field_spans(data, offs, model)
    right = sum(any(planted[i].encode()[a:b].decode() == x for a, b in tagged.get(i, [])) for i, x in enumerate(hidden))
    assert right >= 30


def test_query_and_edges(spark, model):
    out = queries.op12_secret_scan(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "text"), "doc_id").collect()
    assert len(out) == 1000
    for r in out:
        want = plain(r.text or "")
        told = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in want]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [x for x in every if not x.startswith("crf")] == told and [int(x.split(":")[1]) for x in every] == sorted(int(x.split(":")[1]) for x in every)
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, 'é token="abcdef"', 3), (3, "w " * 300000 + "AKIA" + "A" * 16, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secret_scan.span_digests(secret_scan.secret_spans(df, model)).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_access) for r in got) == [(0, 0, 0), (1, 0, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1)]
    assert next(r.spans for r in got if r.doc_id == 2).split(",")[0] == "assign:9:15"
    assert secret_scan.fit(df.limit(0)) is None and secret_scan.secret_spans(df.limit(0), None).count() == 0
    # the sample is by hash of the text: it does not depend on how rows lie
    docs = table(spark, DATA, "documents").where("doc_id < 300")
    one, two = secret_scan.fit(docs.repartition(3), 40), secret_scan.fit(docs.repartition(5), 40)
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])
    assert secret_scan.fit(docs.where(~F.col("text").rlike("[0-9]")), 40) is None


def test_bytes_that_are_no_utf8(spark, tmp_path):
    raw = [b"token=abcdef\xff x", b"\xffo\xc3 token=abcdef 0123456789abcdef01234567", "é token=abcdef".encode(), None]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw binary").selectExpr("doc_id", "cast(raw as string) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_secret_scan(spark, str(tmp_path)).collect():
        told = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in plain((raw[r.doc_id] or b"").decode(errors="replace"))]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest() and r.n_assign == (r.doc_id < 3)
