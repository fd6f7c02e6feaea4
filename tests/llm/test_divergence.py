"""The divergence audit against a plain count, and the radix selection against sorting."""

import random
import re
from collections import Counter, defaultdict

from tessella.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, min_docs, top):
    rows = [(t or "", g or "", s or "") for _, t, g, s in rows]
    used, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        groups[lang].add(source)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        used[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        terms = [t for t, n in held[lang].items() if n >= min_docs]
        everything = sum((used[lang, s] for s in sources), Counter())

        def shares(count):
            n = sum(count[t] for t in terms)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(terms)) for t in terms}

        p, q = {s: shares(used[lang, s]) for s in sources}, shares(everything)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in terms)) for o in sources if o != s]
            over = [(t, p[s][t] - q[t]) for t in terms if used[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found[:most], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_plain_count(spark):
    rng = random.Random(5)
    names = ["é", "ß", "Ab", "zz", "x", "Ünï", "ſ", "日本"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, rng.choice([" ", "\n", "1", "_"]).join(rng.choices(names, weights=range(1, len(names) + 1), k=rng.randrange(40))), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "b", "c", None])) for i in range(300)]
    rows += [(7, None, "en", "a"), (7, None, "en", "a"), (None, "", "xx", "only"), (None, "12 34", "xx", "other"), rows[0], rows[0], (8, "zz " * 5000, "de", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(divergence.divergence_audit(df, 20, 6)) == plain(rows, 20, 6)
    extra = df.selectExpr("*", "1 AS n", "2 AS term", "3 AS item", "4 AS p", "5 AS _salt")
    assert got(divergence.divergence_audit(extra, 20, 6)) == plain(rows, 20, 6)


def test_long_text_and_flush_change_nothing(spark, monkeypatch):
    rows = [(i, "ab cd ef gh " * (i + 1) + f"only{'x' * i}", "en", f"s{i % 3}") for i in range(12)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 12, "source": [f"s{i % 3}" for i in range(12)], "text": pa.array([r[1].encode() for r in rows], pa.binary())})

    def summed():
        out = Counter()
        for b in divergence._count_terms([batch, batch]):
            for r in b.to_pylist():
                out[r["source"], r["term"], "n"] += r["n"]
                out[r["source"], r["term"], "docs"] += r["docs"]
        return out

    want = summed()
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    monkeypatch.setattr(divergence, "LONG_TEXT", 10)
    assert summed() == want and want["s0", "ab", "docs"] == 8


def test_empty_table_and_no_kept_terms(spark):
    assert got(divergence.divergence_audit(spark.createDataFrame([], SCHEMA))) == []
    two = spark.createDataFrame([(1, "a b", "en", "x"), (2, "b c", "en", "y")], SCHEMA)
    assert got(divergence.divergence_audit(two)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_radix_top_refines_ties_by_bytes(spark):
    rng = random.Random(1)
    items = sorted({"".join(rng.choices("abé日z", k=rng.randrange(1, 9))) for _ in range(400)})
    rows = [("hot", x, rng.choice([5, 5, 5, 5, 1 << 29, 1023, 1024])) for x in items] + [("tied", x, 7) for x in items] + [("few", x, i) for i, x in enumerate(items[:3])] + [("zero", x, 0) for x in items[:30]]
    df = spark.createDataFrame(rows, "g string, item string, value long").repartition(5)
    for k in (1, 10, 250):
        want = []
        for g in ("hot", "tied", "few", "zero"):
            mine = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1].encode()))[:k]
            want += [(*r, i) for i, r in enumerate(mine, 1)]
        for few in (1, 4096):
            assert got(divergence.radix_top(df, ["g"], k, few=few)) == sorted(want)
