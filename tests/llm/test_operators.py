"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and extra columns."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import chat_tools, common, decontaminate, license_scan, packing, quality, simhash, substring_dedup, suffix_dedup, voronoi_knn, warc
from tessella.llm.license_texts import KNOWN

LOREM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"
TEXTS = [
    None, "", "  \n\t ", "one", LOREM, LOREM + " and more", "x " + LOREM, LOREM.upper(), LOREM + " " + LOREM, "é " * 400, "word " * 3000,
    " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(300, 1200)), " ".join(f"w{i}" for i in range(899)) + " end",
    "a\x0bb\x0cc d " + LOREM[:80], "z" * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i * 2) for i, t in enumerate(TEXTS)] + [(3, "one", 1), (100, TEXTS[11], 0), (101, TEXTS[5], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, g long")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]


def test_license_scan(spark, docs, empty):
    known = license_scan.known_licenses(spark)
    more = docs.unionByName(spark.createDataFrame([(200, "Copyright (c) 1999, A. Person\n\n" + KNOWN["MIT"].replace(",", ";").upper(), 0), (201, KNOWN["Zlib"] + " extra", 0)], docs.schema))
    got = {r.doc_id: r.license_id for r in license_scan.scan(more, known).collect()}
    assert got[200] == "MIT" and got[201] is None and got[1] is None and license_scan.scan(empty, known).count() == 0
    assert license_scan.scan(more, known).count() == more.count()


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "p" * 150), (2, None, "p" * 150), (3, "http://c", None), (4, "u\n", ""), (5, "u", "short"), (6, "u", "short"), (0, "u", "q" * 500_000), (None, "u", "p" * 150)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert got[1].record_type == "response" and got[2].record_type == "revisit" and got[2].refers_to == 1 and got[None].refers_to == 1
    assert got[5].record_type == got[6].record_type == "response" and got[3].payload_bytes == 0
    assert got[2].payload_bytes == 150 and got[2].payload_digest == hashlib.sha256(b"p" * 150).hexdigest() and bytes(got[0].block) == b"q" * 500_000
    assert warc.round_trip(pages.where("false")).count() == 0


@pytest.mark.parametrize("window", [13, 5])
def test_substring_dedup(docs, empty, window):
    rows = rows_of(docs)
    first = {}
    for i, t in sorted(rows):
        w = t.split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.substring_dedup_digests(docs, window).collect()]
    assert sorted(got) == sorted(want)
    texts = substring_dedup.substring_dedup(docs, window).collect()
    assert sorted(len(r.text.encode().split()) for r in texts) == sorted(n - g for _, n, g, _ in want)
    assert substring_dedup.substring_dedup_digests(empty, window).count() == 0


def test_ladder():
    assert substring_dedup.ladder(13) == [7, 13] and substring_dedup.ladder(50, 13) == [13, 25, 50]


def test_chat_tools(spark):
    call = lambda *calls: json.dumps({"tool_calls": list(calls)})
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", call({"id": "b", "name": "add", "arguments": {"y": 2, "x": 1}, "depends_on": ["a"]}, {"id": "a", "name": "get", "arguments": '{"q": "k"}'})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": 3})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "v"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "none", "content": 1})),
        (2, 0, "assistant", call({"id": "c", "name": "add", "arguments": {"x": "no"}, "depends_on": ["d"]}, {"id": "d", "name": "add", "arguments": {}, "depends_on": ["c"]})),
        (None, None, None, None), (1, 0, "user", "hi"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tools = spark.createDataFrame([("add", '{"properties": {"x": {"type": "integer"}}, "required": ["x", "y"]}')], "name string, schema string")
    out = chat_tools.link_tool_calls(df, tools)
    order = [(r.kind, r.call_id) for r in out.where("conv_id = 1 and kind <> 'message'").orderBy("order_turn", "depth", "turn", "pos").collect()]
    assert order == [("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("result", "none")]
    by = {(r.kind, r.call_id): r for r in out.collect()}
    assert by["call", "c"].status == by["call", "d"].status == "cycle" and by["result", "none"].status == "orphan"
    assert by["call", "c"].errors == ["x: wrong type", "y: missing"] and by["call", "b"].errors == []
    assert by["call", "b"].canonical == '{"arguments":{"x":1,"y":2},"depends_on":["a"],"id":"b","name":"add","role":"assistant"}'
    assert out.count() == 10 and chat_tools.link_tool_calls(df.where("false")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_decontaminate(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seven wizards pack my box with five dozen liquor jugs."
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (10, "tiny"), (11, "  ")], "item_id long, text string")
    edited = item.replace("quick", "quikc").replace("seven", "six")
    rows = [(300, "é " + item.upper() + " end"), (301, LOREM + edited + LOREM), (302, item[:60]), (303, "It was Too  Short."), (304, "it was too shortened"), (305, " tiny\n"), (306, "tiny thing")]
    more = docs.unionByName(spark.createDataFrame([(*r, 0) for r in rows], docs.schema))
    for slice_bytes in (1 << 20, 50):
        got = {r.doc_id: r for r in decontaminate.contaminated_spans(more, bench, slice_bytes=slice_bytes).collect()}
        assert {k: r.item_id for k, r in got.items()} == {300: 7, 301: 7, 303: 9, 305: 10} and got[300].distance == 0 and 0 < got[301].distance <= 10
        assert ("é " + item + " end").encode()[got[300].start : got[300].start + got[300].length].decode() == item
        assert (got[305].start, got[305].length) == (1, 4)
        assert decontaminate.clean_documents(more, bench, slice_bytes=slice_bytes).count() == more.count() - 4
    assert decontaminate.contaminated_spans(empty, bench).count() == 0 and decontaminate.clean_documents(docs, bench.where("false")).count() == docs.count()


def _edits(x, y):
    """The edits that turn x into some part of y, and into y."""
    part, whole = list(range(1)) * (len(y) + 1), list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        now, all_ = [i], [i]
        for j, b in enumerate(y, 1):
            now.append(min(part[j] + 1, now[-1] + 1, part[j - 1] + (a != b)))
            all_.append(min(whole[j] + 1, all_[-1] + 1, whole[j - 1] + (a != b)))
        part, whole = now, all_
    return min(part), whole[-1]


def test_decontaminate_against_edit_distance(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [" ".join(word() for _ in range(n)) for n in (8, 9, 12, 20, 30, 60, 60)]
    items.append(items[3])
    texts = []
    for t in items:
        for edits in (0, 1, len(t) // 10 - 1, len(t) // 10, len(t) // 10 + 1, len(t) // 6):
            x = list(t)
            for _ in range(edits):
                p, how = rng.randrange(len(x)), rng.randrange(3)
                x[p : p + 1] = [[], [rng.choice("xyz")], [x[p], rng.choice("xyz")]][how]
            for before, after in (("", ""), (word() + " ", " " + word()), (" ".join(word() for _ in range(20)) + " ", " ".join(word() for _ in range(20)))):
                texts.append(before + "".join(x) + after)
    texts += [" ".join(word() for _ in range(50)) for _ in range(20)] + [items[4][20:], items[4][: len(items[4]) - 12], items[5] + " " + items[6]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {}
    for r in decontaminate.contaminated_spans(docs, bench).collect():
        got[r.doc_id, r.item_id] = min(got.get((r.doc_id, r.item_id), 99), r.distance)
        assert _edits(items[r.item_id], texts[r.doc_id][r.start : r.start + r.length])[1] == r.distance
    want = {(d, i): k for d, t in enumerate(texts) for i, x in enumerate(items) if (k := _edits(x, t)[0]) <= min(len(x) // 10, (len(x) - 8) // 8)}
    assert got == want and len(want) > 60


def test_decontaminate_long_items(spark):
    rng = random.Random(7)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3500))
    docs = spark.createDataFrame([(i, ("x " * i) + item[:9000] + item[9000 + i :]) for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r.distance for r in decontaminate.contaminated_spans(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {i: i + (i % 6 == 5) for i in range(30)}  # a cut that leaves two blanks costs one more


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, quality.learnable(labels), sample=1500)
    some = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, "")], "doc_id long, text string"))
    got = quality.score(some, model)
    held = got.join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    assert held.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("quality")).cast("int"))).head()[0] > 0.97
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality.fit(docs, quality.learnable(labels.where("false")))
    assert quality.score(some.limit(5), none).where("score <> 0.5").count() == 0


def test_quality_votes_as_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (3, "another text of three"), (3, None), (-2, "word " * 90000), (-3, "word " * 90000)], "doc_id long, text string")
    docs = docs.unionByName(extra).repartition(5)
    learn = quality.learnable(labels).unionByName(spark.createDataFrame([(-2, 1.0), (3, None), (None, 1.0)], "doc_id long, label double"))
    model = quality.fit(docs, learn)
    again = quality.fit(docs.repartition(3), learn)
    assert np.array_equal(model.vectors, again.vectors) and np.array_equal(model.labels, again.labels)
    got = quality.score(docs.withColumn("score", F.lit("mine")), model, "vote").collect()
    assert {r.score for r in got} == {"mine"} and len(got) == 1006
    for r in got:
        raw = (r.text or "").encode()
        counts = quality.term_counts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        want = [model.prior]
        if raw:
            x = np.log1p(counts[0]) * model.idf
            v = (x / np.linalg.norm(x)) @ model.axes
            cosine = model.vectors @ (v / np.linalg.norm(v))
            want = []
            for margin in (-1e-4, -2e-5, 0, 2e-5, 1e-4):  # rows as similar as the last, but for rounding, may vote or not
                w = np.maximum(cosine, 0) ** quality.POWER * (cosine >= np.sort(cosine)[-quality.NEIGHBOURS] + margin)
                want.append(float((w * model.labels).sum() / w.sum()) if w.any() else model.prior)
            if r.doc_id == -2:  # a learned row is its own nearest neighbour, whatever its counts
                assert cosine.max() > 0.9999
        assert min(want) - 2e-2 <= r.vote <= max(want) + 2e-2


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = collections.Counter()
    for _, t in rows_of(docs):
        ids[np.array([*hf.encode(t.decode(), add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    for cut in (True, False):
        rows = packing.pack(docs, cut=cut).collect()
        used = collections.defaultdict(list)
        for r in rows:
            used[r.sequence_id].append((r.offset, r.length))
        for pieces in used.values():
            at = 0
            for o, n in sorted(pieces):
                assert o == at
                at += n
            assert at <= 2048 and (not cut or at & (at - 1) == 0)
        assert sum(r.length for r in rows) == sum(len(x) // 4 * n for x, n in ids.items())
        whole = collections.Counter(r.ids_crc32 for r in rows if r.length == r.doc_tokens)
        assert not whole - collections.Counter({k: v for x, n in ids.items() for k, v in {zlib.crc32(x): n}.items()})
    assert packing.pack(empty).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 100, 200).tolist(), reverse=True)
    room, want = [], []
    for i, s in enumerate(sizes):
        b = next((k for k, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
            want.append([])
        room[b] -= s
        want[b].append(i)
    assert packing.first_fit_decreasing(sizes, 100) == want


@pytest.mark.parametrize("nulls", [False, True])
def test_simhash(spark, docs, empty, nulls):
    if nulls:  # null doc_ids link, bridge and take the smallest id reachable
        words = [f"w{i}" for i in range(400)]
        more = [(None, LOREM), (None, "q r s t"), (2000, "q r s t"), (None, "alone for itself"), (None, TEXTS[13] + "s")] + [(None if k % 2 else 1000 + k, " ".join(words[: 390 + k])) for k in range(8)]
        docs = docs.unionByName(spark.createDataFrame([(i, t, 0) for i, t in more], docs.schema))
    rows, fps = rows_of(docs), []
    for _, t in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in t).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up, last = list(range(len(rows))), lambda i: (i is None, i or 0)
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2:
                    up[i] = min(up[i], up[j], key=lambda k: (last(rows[k][0]), k))
    order = lambda r: (last(r[0]), r[1], last(r[2]))
    want = sorted(((i, f"{f:016x}", rows[up[k]][0]) for k, ((i, _), f) in enumerate(zip(rows, fps))), key=order)
    assert sorted(map(tuple, simhash.simhash_components(docs).collect()), key=order) == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("bits,radius", [(64, 2), (128, 30)])
def test_bit_sliced_links(bits, radius):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (40, bits // 64), dtype=np.int64).astype(np.uint64)
    fp = np.concatenate([base, base ^ np.uint64(1), base ^ np.uint64(7), base[:, ::-1]])
    group = np.sort(rng.integers(0, 6, len(fp)))
    got = set(zip(*(x.tolist() for x in simhash.links_within(group, fp, radius)[:2])))
    assert got == {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if group[i] == group[j] and np.bitwise_count(fp[i] ^ fp[j]).sum() <= radius}


def test_near_duplicates(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-4])), (3, " ".join(words)), (4, " ".join(words[150:] + words[:150])), (5, " ".join(f"v{i}" for i in range(300))), (6, None), (7, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 7: 6}


def test_near_duplicates_by_row(spark):
    words = [f"w{i}" for i in range(300)]
    w, u, uz, n = " ".join(words), " ".join(f"u{i}" for i in range(300)), " ".join([f"u{i}" for i in range(300)] + ["z"]), " ".join(f"n{i}" for i in range(300))
    rows = [(0, w, 1), (1, w, 2), (1, u, 3), (None, n, 4), (None, n, 5), (5, n, 6), (7, uz, 7), (7, uz, 8), (8, "alone", 9), (9, "twice", 10), (9, "twice", 10), (None, "lost", 11), (None, "lost", 12), (None, "single", 13)]
    left = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, maybe int").repartition(5)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in left) == sorted([(0, w), (1, u), (5, n), (8, "alone"), (9, "twice"), (-1, "lost"), (-1, "single")])
    assert {tuple(r) for r in left} <= set(rows)


def test_groups_of_null_ids_are_even(spark):
    rows = [(None if i % 3 else i, f"{i} " * 200) for i in range(3000)]
    sizes = [r.n for r in common.in_groups(spark.createDataFrame(rows, "doc_id long, text string"), 30 * common.GROUP_BYTES).groupBy("g").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 30 and max(sizes) < 2 * min(sizes)


@pytest.mark.parametrize("hot", [1 << 19, 1200, 0])
def test_suffix_dedup(docs, empty, hot):
    rows, n = rows_of(docs), 200
    count = collections.Counter(t[j : j + n] for _, t in rows for j in range(len(t) - n + 1))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - n + 1):
            if count[t[j : j + n]] > 1:
                gone[j : j + n] = True
        spans = int((gone[1:-1] & ~gone[:-2]).sum() + gone[:1].sum()) if len(t) else 0
        want.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    assert sorted(map(tuple, suffix_dedup.suffix_dedup_digests(docs, hot_bytes=hot).collect())) == sorted(want)
    assert suffix_dedup.suffix_dedup_digests(empty).count() == 0
    assert suffix_dedup.repeated_spans(docs).agg(F.sum("length")).head()[0] == sum(w[2] for w in want)


def test_voronoi_knn(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.3, (300, 8)).astype(np.float32).tolist()
    v[7], v[8], v[9], v[10], v[11] = None, [0.1, None] * 4, [float("nan")] * 8, [float("inf")] * 8, v[12]
    rows = [(i, x) for i, x in enumerate(v)] + [(None, v[0]), (500, v[0])]
    df = voronoi_knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, voronoi_knn.knn_join(df, F.col("vec_id") % 50 == 0, pivots=9, chunk=20).collect()))
    good = {i: np.floor(256 * np.array(x, np.float32).astype(np.float64)).astype(int) for i, x in rows if i is not None and i not in (7, 8, 9, 10)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert voronoi_knn.knn_join(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_sieve(spark):
    df = spark.range(2000).toDF("i").unionByName(spark.createDataFrame([(None,)], "i long"))
    out = common.without(df, "i", spark.range(0, 2000, 7).toDF("j"))
    assert out.count() == 2001 - len(range(0, 2000, 7)) and out.where("i % 7 = 0").count() == 0


def _brute_groups(rows, shingle, similarity):
    """The smallest id of every document's group, from the exact Jaccard similarity of all pairs."""
    ids, sets = [x for x, _ in rows], []
    for _, text in rows:
        w = text.lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    at = {}
    for i, x in enumerate(sets):
        for s in x:
            at.setdefault(s, []).append(i)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        common = {}
        for s in x:
            for j in at[s]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= similarity * (len(x) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return {x: least[root(i)] for i, x in enumerate(ids)}


def _star(copies, seed, words=200, changed=3):
    """A text and copies of it with a few words changed each: near to the text, far from each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = [(seed * 10**6, " ".join(base))]
    for i in range(copies):
        t = list(base)
        for p in rng.sample(range(words), changed):
            t[p] = f"c{rng.randrange(10**9)}"
        rows.append((seed * 10**6 + 1 + i, " ".join(t)))
    return rows


def test_near_duplicates_joins_large_stars(spark):
    # 1000 copies of one text, 0.86 to the text and 0.75 to each other; smaller stars; copies without their text
    rows = _star(1000, 1) + [r for s in range(2, 8) for r in _star(20, s)] + _star(60, 9)[1:]
    want = _brute_groups(rows, 5, 0.8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    dropped = {x for x, m in want.items() if m != x}
    assert len(dropped) > 1000
    assert {x: want[x] for x in got} == got  # nothing joined that brute force keeps apart
    # a pair further apart than the radius may be missed, about one in 6000 at just 0.8
    assert len(dropped - set(got)) <= 3


def test_joining_checks_every_pair_left_apart():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)] + [np.zeros(0, np.uint64)]
    i, j = np.triu_indices(len(sets), 1)
    label = np.arange(len(sets))
    got = simhash.joining(i, j, rng.integers(0, 30, len(i)), label, sets, 0.4)
    good = lambda x, y: len(np.intersect1d(sets[x], sets[y])) >= max(1e-9, 0.4 * len(np.union1d(sets[x], sets[y])))
    assert all(good(x, y) for x, y in got)
    comp = label.copy()
    for x, y in got:
        comp[comp == comp[y]] = comp[x]
    assert all(comp[x] == comp[y] for x, y in zip(i, j) if good(x, y))


@pytest.mark.parametrize("case", ["negative", "copies", "both", "few"])
def test_voronoi_knn_keeps_cells_at_the_bound(spark, case):
    rng = np.random.default_rng(3)
    base = [[0.0, -4.0]] + [[0.0, 3.0 + i] for i in range(6)]
    rows = {
        "negative": [(i * 50, v) for i, v in enumerate(base)],  # all scores of row 0 are under -1000
        "copies": [(0, [2.0, 0.0])] * 6 + [(i, [1.0 / i, 0.0]) for i in range(1, 7)],
        "both": [(int(i), v.tolist()) for i, v in zip(rng.integers(0, 120, 400), rng.normal(-2, 3, (400, 3)))] + [(100, [9.0, 9.0, 9.0])] * 8,
        "few": [(0, [1.0, 0.0])] * 7 + [(1, [-30.0, 0.0])],
    }[case]
    df = voronoi_knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    v = [(i, np.floor(256 * np.array(x)).astype(np.int64)) for i, x in rows]
    want = []
    for q in sorted({i for i, _ in v if i % 50 == 0}):
        copies = [x for i, x in v if i == q]
        best = sorted((-int(x @ y), i) for x in copies for i, y in v if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, voronoi_knn.knn_join(df, F.col("vec_id") % 50 == 0).collect())) == want


def test_license_scan_takes_every_wrap(spark):
    import textwrap

    rows, want = [], []
    for name, text in sorted(KNOWN.items()):
        parts = [" ".join(p.split()) for p in text.split("\n\n")]
        bodies = [" ".join(parts)] + ["\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in parts) for w in (1, 25, 40, 60, 72, 79, 100)]
        heads = ["", "Copyright (c) 2020 Jane Doe\n\n", "Copyright Jane Doe\nAll rights reserved.\n\n", "© 2019-2021 Doe Ltd.\n", f"{name.split('-')[0]} License\n\nCopyright (c) Jane Doe\n"]
        for body in bodies:
            for head in heads:
                rows.append((len(rows), head + body))
                want.append(name)
    rows += [(len(rows), "The MIT License (MIT)\r\n\r\n" + KNOWN["MIT"].replace("\n", "\r\n")), (len(rows) + 1, "Some words\ncopyright holders say"), (len(rows) + 2, "Some words copyright\nholders say"), (len(rows) + 3, "Some words")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), license_scan.known_licenses(spark)).collect()}
    n = len(want)
    assert [(i, want[i], got[i].license_id) for i in range(n) if got[i].license_id != want[i]] == []
    assert got[n].license_id == "MIT"
    docs = spark.createDataFrame([(1, "a\nReleased under the MIT license!\r\nb"), (1, "MIT License\n* Licensed under CC BY-NC 4.0"), (2, "x released under the MIT License."), (None, "Released under the MIT License."), (3, None)], "doc_id long, text string")
    lines = sorted(map(tuple, license_scan.scan_lines(docs, license_scan.known_licenses(spark)).collect()), key=str)
    assert lines == sorted([(1, "MIT-notice"), (1, "CC-BY-NC-4.0-notice"), (None, "MIT-notice")], key=str)
    assert got[n + 1].canonical_sha256 == got[n + 2].canonical_sha256 != got[n + 3].canonical_sha256


def test_chat_tools_keeps_text_beside_calls_and_reads_nested_functions(spark):
    schema = {"type": "object", "properties": {"q": {"type": "string"}}, "required": ["q"]}
    call = lambda i, a: {"id": i, "type": "function", "function": {"name": "find", "arguments": a}}
    rows = [
        (1, 0, "system", json.dumps({"tools": [{"type": "function", "function": {"name": "find", "parameters": schema}}]})),
        (1, 1, "assistant", json.dumps({"content": "Let me \"look\"", "tool_calls": [call("a", '{"q":"x"}'), call("b", {"q": 1})]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "found"})),
        (2, 0, "assistant", json.dumps({"content": None, "tool_calls": [call("a", "{}")]})),
        (3, 0, "assistant", json.dumps({"content": [{"text": "parts", "type": "text"}], "tool_calls": [{"id": "a", "name": "find", "arguments": {}}]})),
    ]
    out = chat_tools.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.turn, r.pos, r.kind): r for r in out.collect()}
    assert len(got) == out.count() == 8
    assert json.loads(got[1, 1, -1, "message"].canonical) == {"content": 'Let me "look"', "role": "assistant"}
    assert json.loads(got[3, 0, -1, "message"].canonical)["content"] == [{"text": "parts", "type": "text"}]
    a, b, other = got[1, 1, 0, "call"], got[1, 1, 1, "call"], got[2, 0, 0, "call"]
    assert json.loads(a.canonical)["name"] == "find" and json.loads(a.canonical)["arguments"] == {"q": "x"}
    assert a.known_tool and a.errors == [] and a.status == "ok" and b.known_tool and b.errors == ["q: wrong type"]
    assert not other.known_tool and json.loads(other.canonical)["arguments"] == {}


@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "MPL-2.0"])
def test_digests_of_long_licences(spark, name):
    import pathlib
    import textwrap

    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no licence texts here")
    text = path.read_text(encoding="utf-8")
    wrapped = "\n\n".join(textwrap.fill(" ".join(p.split()), 60, break_on_hyphens=False) for p in text.split("\n\n"))
    docs = spark.createDataFrame([(0, text), (1, wrapped), (2, text.replace("\n", "\r\n").upper()), (3, text[:-200])], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs, license_scan.known_licenses(spark)).collect()}
    want = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0"}.get(name, name)
    assert got[0] == got[2] == want and got[3] is None and got[1] in (want, None)


def test_chat_tools_orders_deep_graphs_and_reads_nested_schemas(spark):
    rng = random.Random(4)
    rows, graph = [], {}
    for conv in range(4):
        n = 40
        for k in range(n):  # conversation 0 is one chain, 1 a chain that ends in a circle, the others are random
            deps = [k + 1] if k + 1 < n else ([n - 5] if conv == 1 else [])
            if conv > 1:
                deps = [j for j in rng.sample(range(n), 3) if j > k or (conv == 3 and rng.random() < 0.05)][: rng.randrange(4)]
            graph[conv, f"k{k}"] = [f"k{j}" for j in deps]
            rows.append((conv, k, "assistant", json.dumps({"tool_calls": [{"id": f"k{k}", "name": "f", "arguments": {}, "depends_on": [f"k{j}" for j in deps] + ["unknown"]}]})))
            if k % 3:
                rows.append((conv, 100 + (7 * k) % 40, "tool", json.dumps({"tool_call_id": f"k{k}", "content": k})))
    answer = {(r[0], json.loads(r[3])["tool_call_id"]): r[1] for r in rows if r[2] == "tool"}
    after, at, seen = {}, {}, set()

    def visit(x):
        if x in after:
            return
        if x in seen:
            after[x] = None
            return
        seen.add(x)
        deps = [(x[0], d) for d in graph[x]]
        for d in deps:
            visit(d)
        if x not in after:
            after[x] = None if any(after[d] is None for d in deps) else max([after[d] + 1 for d in deps], default=0)
            at[x] = max([int(x[1][1:])] + [max(at[d], answer.get(d, -1)) for d in deps if after[d] is not None])

    for x in graph:
        visit(x)
    bad = {x for x in graph if after[x] is None}
    while more := {x for x in graph if x not in bad and any((x[0], d) in bad for d in graph[x])}:
        bad |= more
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in chat_tools.link_tool_calls(docs).where("kind = 'call'").collect()}
    assert {x for x, r in got.items() if r.status == "cycle"} >= {(1, f"k{k}") for k in range(40)}
    for x in graph:
        if x not in bad:
            assert (got[x].depth, got[x].order_turn) == (2 * after[x], at[x]), x
    assert all((got[x].status == "cycle") == (x in bad) for x in graph)

    schema = {"type": "object", "properties": {"a": {"type": ["string", "null"]}, "n": {"type": "number", "enum": [1, 2.5]}, "o": {"type": "object", "properties": {"l": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}, "additionalProperties": False}}}}}, "required": ["a"]}
    cases = [
        ({"a": None, "n": 2.5, "o": {"l": [{"x": 1}]}}, []), ({"a": 1, "n": 3}, ["a: wrong type", "n: not one of the allowed"]), ({}, ["a: missing"]), ([1], ["arguments: not an object"]), (None, ["arguments: not an object"]),
        ({"a": "", "o": {"l": [{"x": 1}, {"x": 1.5}, {"y": 2}, 7]}}, ["o.l[1].x: wrong type", "o.l[2].x: missing", "o.l[2].y: not allowed", "o.l[3]: wrong type"]), ({"a": "", "o": {"l": {}}}, ["o.l: wrong type"]),
    ]
    rows = [(0, k, "assistant", json.dumps({"tool_calls": [{"id": str(k), "name": "f", "arguments": x}]})) for k, (x, _) in enumerate(cases)]
    tools = spark.createDataFrame([("f", json.dumps(schema)), ("g", None), (None, "{}")], "name string, schema string")
    out = chat_tools.link_tool_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tools)
    got = {r.turn: r for r in out.collect()}
    assert {k: r.errors for k, r in got.items()} == {k: sorted(e) for k, (_, e) in enumerate(cases)}
    assert '"n":2.5,"o":{"l":[{"x":1}]}' in got[0].canonical and '"n":3}' in got[1].canonical  # numbers stay as they were
