"""Operator 8: SimHash near-dedup with bit-sliced comparison.

1. Every text gives a fingerprint of 64 or 128 bits (`fingerprints`). Equal fingerprints collapse to one node, named by
   the fingerprint itself (or, where links are checked, by the smallest doc_id), before anything is compared.
2. Nodes meet in buckets of equal bits (`keys`). For a radius r the bits are cut into r + 3 blocks and every choice of
   three blocks is a key, so any two fingerprints within the radius share at least one: no link is lost. For a wide
   radius (`sampled_keys`) the keys are seeded random subsets of the bits, as many as the wanted recall needs.
3. Inside a bucket, bit planes are stored vertically (64 nodes to a word). Node i is compared with node i + 1, i + 2, ...
   for all i at once: a plane is XORed with itself shifted, and carry-save counters, saturating past the radius, add
   the result to all distances of the word. Words of which all 64 distances exceed the radius are abandoned.
4. A bucket hands on a minimum spanning forest of its links (by distance), at most one row per node, never all pairs.
   Buckets of more than `BLOCK` nodes are cut into blocks and every pair of blocks is a task of its own, so that no
   bucket gathers in one task.
5. `components` joins the forests by alternating large-star and small-star steps.
6. Where links are checked on the sets themselves (`near_duplicates`), a forest is only a first guess: a node's nearest
   fingerprint may fail the check while a farther one passes. `unjoined_links` therefore checks every pair within the
   radius whose ends the forests' good links left apart.

Edge cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; rows that repeat a doc_id are one node each text; rows of a null doc_id link and bridge like any other, and
only a component of nothing but null doc_ids has a null component_id; empty tables give empty results.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BLOCK = 4096
ROWS_AT_ONCE = 1 << 16
CHECK_BLOCK = 128  # nodes of a block that bring their sets of shingles with them
PIECE = 32 * CHECK_BLOCK
RADIUS = 2
SHINGLE = 3
PARTS = 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = c.Rolling(8)
_SEQ = c.Rolling(88)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per row: the bits set in over half of its 64-bit hashes. Rows without hashes give zero."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    rows = np.flatnonzero(n)
    if not len(rows):
        return out
    cuts = np.r_[np.arange(0, len(rows), 512), len(rows)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        lo, hi = first[rows[a]], first[rows[b - 1] + 1]
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[rows[a:b]] - lo, axis=0, dtype=np.int32)
        out[rows[a:b]] = np.packbits(2 * ones > n[rows[a:b], None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _xxh_shingles(col, shingle: int) -> np.ndarray:
    """The contract's fingerprint: XXH64, seed 42, of space-joined shingles of lower-cased words."""
    data, offs = c.utf8(col)
    out = []
    digest = xxhash.xxh64_intdigest
    for a, b in c.chunks(offs):
        lo = offs[a]
        part = _LOWER[data[lo : offs[b]]]
        s, e, first = c.words(part, offs[a : b + 1] - lo)
        size = e - s + 1  # words, each with one space, moved together
        to = np.r_[0, np.cumsum(size)]
        at = np.repeat(s - to[:-1], size) + np.arange(to[-1])
        flat = part[np.minimum(at, max(len(part) - 1, 0))]
        flat[to[1:] - 1] = 0x20
        raw = flat.tobytes()
        n = np.diff(first)
        k = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
        new = np.r_[0, np.cumsum(k)]
        start = np.repeat(first[:-1] - new[:-1], k) + np.arange(new[-1])
        stop = np.minimum(start + shingle, np.repeat(first[1:], k))
        hashes = np.fromiter((digest(raw[x:y], 42) for x, y in zip(to[start].tolist(), (to[stop] - 1).tolist())), np.uint64, len(start))
        out.append(_majority(hashes, new))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _distinct_shingles(data: np.ndarray, offs: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct digests of every row's shingles, and each row's first (one more at the end)."""
    part = _LOWER[data]
    s, e, first = c.words(part, offs)
    n = np.diff(first)
    k = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    new = np.r_[0, np.cumsum(k)]
    row = np.repeat(np.arange(len(n)), k)
    start = first[:-1][row] - new[:-1][row] + np.arange(new[-1])
    stop = np.minimum(start + shingle, first[1:][row])
    h = _SEQ.slices(_SEQ.sums(c.word_hashes(part, s, e, _WORD)), start, stop)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    return h[keep], np.searchsorted(row[keep], np.arange(len(n) + 1))


def _wide_shingles(col, shingle: int) -> np.ndarray:
    """128-bit fingerprints (two words a row) over distinct shingles, from rolling digests."""
    data, offs = c.utf8(col)
    out = []
    for a, b in c.chunks(offs):
        h, first = _distinct_shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)
        out.append(np.stack([_majority(h, first), _majority(c.mix(h ^ np.uint64(0x9E3779B97F4A7C15)), first)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """(doc_id, fp): fp is a long, or an array of two longs where wide."""

    def f(batches):
        for batch in batches:
            fp = (_wide_shingles if wide else _xxh_shingles)(batch.column("text"), shingle).view(np.int64)
            fp = pa.FixedSizeListArray.from_arrays(pa.array(fp.ravel()), 2).cast(pa.list_(pa.int64())) if wide else pa.array(fp)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(f, f"doc_id long, fp {'array<long>' if wide else 'long'}")


def keys(bits: int, radius: int, extra: int = 3) -> np.ndarray:
    """Masks (rows of 64-bit words) of which any two fingerprints within the radius agree on at least one."""
    cuts = np.linspace(0, bits, radius + extra + 1).astype(int)
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts[:-1], cuts[1:])]
    return _masks([sum(x) for x in itertools.combinations(blocks, extra)], bits)


def sampled_keys(bits: int, n: int, p_differ: float, recall: float, seed: int = 8) -> np.ndarray:
    """Random masks of about log2(n) bits, as many as find a pair that differs in a share p_differ of the bits with that recall."""
    width = max(16, math.ceil(math.log2(max(n, 2))) - 4)
    many = math.ceil(math.log(1 - recall) / math.log(1 - (1 - p_differ) ** width))
    rng = np.random.default_rng(seed)
    return _masks([sum(1 << int(i) for i in rng.choice(bits, width, replace=False)) for _ in range(many)], bits)


def _masks(masks: list[int], bits: int) -> np.ndarray:
    return np.array([[m >> (64 * k) & (2**64 - 1) for k in range(bits // 64)] for m in masks], dtype=np.uint64)


def _planes(fp: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word."""
    n = -(-len(fp) // 64) * 64
    flat = np.zeros((n, bits // 64), np.uint64)
    flat[: len(fp)] = fp
    by_bit = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(n, bits // 8), axis=1, bitorder="little").T
    return np.packbits(np.ascontiguousarray(by_bit), axis=1, bitorder="little").view("<u8")


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """The planes moved down by that many lanes."""
    words, lanes = divmod(by, 64)
    a = planes[:, words:]
    if not lanes:
        return a
    nxt = np.concatenate([planes[:, words + 1 :], np.zeros((len(planes), 1), np.uint64)], axis=1)
    return (a >> np.uint64(lanes)) | (nxt << np.uint64(64 - lanes))


def near(planes: np.ndarray, shifted: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes (as bits of words) of distance at most radius, among the valid ones."""
    depth = max(1, int(radius).bit_length())
    start = (1 << depth) - 1 - radius  # counters begin here, so passing the radius carries out of the top
    live = np.flatnonzero(valid)
    out = np.zeros(len(valid), np.uint64)
    if not len(live):
        return out
    every = np.uint64(2**64 - 1)
    count = [np.full(len(live), every if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    over = ~valid[live]
    for b in range(len(planes)):
        carry = planes[b, live] ^ shifted[b, live]
        for k in range(depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7:
            keep = over != every
            if not keep.all():
                live, over, count = live[keep], over[keep], [x[keep] for x in count]
                if not len(live):
                    return out
    out[live] = ~over
    return out


def _pack_valid(flags: np.ndarray) -> np.ndarray:
    n = -(-len(flags) // 64) * 64
    full = np.zeros(n, bool)
    full[: len(flags)] = flags
    return np.packbits(full, bitorder="little").view("<u8")


def links_within(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of the same (sorted) group within the radius, and their distances."""
    n, bits, found = len(group), 64 * fp.shape[1], []
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    each = np.diff(np.r_[head, n])
    size = np.repeat(each, each)
    left = np.repeat(head + each, each) - np.arange(n)  # nodes to the end of the group
    here = np.arange(n)  # nodes whose planes are packed: whole groups, so partners stay as far apart
    planes, off = None, 0
    while True:
        off += 1
        going = size[here] > off
        if not going.any():
            break
        if planes is None or 2 * np.count_nonzero(going) < len(here):
            here = here[going]
            planes = _planes(fp[here], bits)
        a = planes[:, : planes.shape[1] - off // 64]
        hit = near(a, _shifted(planes, off), _pack_valid(left[here] > off)[: a.shape[1]], radius)
        lanes = np.flatnonzero(np.unpackbits(hit.astype("<u8").view(np.uint8), bitorder="little"))
        found.append((here[lanes], here[lanes] + off))
    i = np.concatenate([x[0] for x in found]) if found else np.zeros(0, int)
    j = np.concatenate([x[1] for x in found]) if found else np.zeros(0, int)
    return i, j, np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int64)


def forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Which links make a minimum spanning forest by distance."""
    up = list(range(n))
    keep = []
    for x in np.argsort(d, kind="stable").tolist():
        a, b = int(i[x]), int(j[x])
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            keep.append(x)
    return np.array(keep, dtype=np.int64)


def _keyed(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """(key, id, f0, f1, ...): every node once for each mask. nodes: (id, fp array)."""
    many, wide = masks.shape
    key_seed = np.arange(1, many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def keyed(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(-1, wide)
            h = np.repeat(key_seed[None, :], len(fp), axis=0)
            for w in range(wide):
                h = c.mix(h + (fp[:, w, None] & masks[None, :, w]))
            rep = lambda x: np.repeat(x, many)
            cols = [pa.array(h.ravel().view(np.int64)), pa.array(rep(ids)), *(pa.array(rep(fp[:, w]).view(np.int64)) for w in range(wide))]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = ["key", "id", *(f"f{w}" for w in range(wide))]
    return nodes.select("id", "fp").mapInArrow(keyed, ", ".join(f"{x} long" for x in names))


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Keyed rows with `task` and `side` in place of the key: tasks of one bucket (side -1), or of two blocks of a large one."""
    names = rows.columns[1:]
    # buckets over the block size are few; they alone are dealt to pairs of blocks, each a task of its own
    hot = c.kept(rows.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    rows = rows.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("x", F.least("mine", "other")).withColumn("y", F.greatest("mine", "other"))
    rows = rows.withColumn("task", F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", "x", "y")))
    return rows.select("task", F.when(F.col("x") == F.col("y"), -1).otherwise(F.col("mine")).alias("side"), *names)


def links(nodes: DataFrame, masks: np.ndarray, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b, distance): for every bucket a minimum spanning forest of the links within the radius. nodes: (id, fp array)."""
    wide = masks.shape[1]

    def compare(batches):
        """Rows come sorted by task, so whole tasks are compared as they pass, never a whole partition at once."""
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch)
            if not held or (batch is not None and sum(map(len, held)) < ROWS_AT_ONCE):
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            task = rows.column("task").to_numpy()
            cut = len(task) if batch is None else int(np.searchsorted(task, task[-1]))  # the last task may go on
            if cut:
                yield compared(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()

    def compared(rows: pa.Table) -> pa.RecordBatch:
        get = lambda k: rows.column(k).to_numpy()
        task, ids, side = get("task"), get("id"), get("side")
        fp = np.stack([get(f"f{w}").view(np.uint64) for w in range(wide)], axis=1)
        i, j, d = links_within(task, fp, radius)
        cross = (side[i] < 0) | (side[i] != side[j])  # two blocks: pairs across them only
        i, j, d = i[cross], j[cross], d[cross]
        pick = forest(i, j, d, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[i[pick]]), pa.array(ids[j[pick]]), pa.array(d[pick])], ["a", "b", "distance"])

    found = _dealt(_keyed(nodes, masks), block).repartition("task").sortWithinPartitions("task", "id").mapInArrow(compare, "a long, b long, distance long")
    return found.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of all nodes that have an edge (a, b): the smallest id reachable."""
    e = c.kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself to the smallest neighbour
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = c.kept(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).head())
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("component_id")).withColumnRenamed("u", "id")
        before = now


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, by 64-bit fingerprints that differ in at most `radius` bits."""
    fps = c.kept(fingerprints(docs, shingle))
    nodes = c.kept(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(nodes.select(F.col("fp").alias("id"), F.array("fp").alias("fp")), keys(64, radius), radius))
    nodes = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").withColumn("label", F.coalesce("component_id", "fp"))
    least = nodes.groupBy("label").agg(F.min("first_id").alias("component_id"))  # null ids alone have none
    nodes = c.kept(nodes.select("fp", "label").join(least, "label").select("fp", "component_id"))
    # every distinct fingerprint is one row here, so a fingerprint shared by many documents is hot on the left side only
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(nodes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): the sorted distinct digests of every text's shingles, as bytes."""

    def f(batches):
        for batch in batches:
            data, offs = c.utf8(batch.column("text"))
            for a, b in c.chunks(offs):
                h, first = _distinct_shingles(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)
                sets = pa.array([h[x:y].tobytes() for x, y in zip(first[:-1], first[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], sets], ["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(f, "doc_id long, shingles binary")


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the ids, each once: copies become one before their sets are built. The sieve lets a few others through."""
    return c.sieved(docs.select("doc_id", "text"), "doc_id", ids).where("maybe").select("doc_id", "text").dropDuplicates(["doc_id"])


def similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least that Jaccard similarity."""
    wanted = c.kept(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = shingle_sets(texts_of(docs, wanted), shingle)
    both = pairs.select("a", "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = both.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")

    def f(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common > 0 and common >= similarity * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return both.mapInArrow(f, "a long, b long")


def joining(i: np.ndarray, j: np.ndarray, d: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links among the pairs (i, j) of that Jaccard similarity that join all labels which any such pair joins.

    Nodes take their turn by mean distance, so the middle of a star comes early; a pair whose ends are joined already, in
    whatever way, is not checked, every other one is.
    """
    n = len(label)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    first = np.r_[0, np.cumsum(size)]
    values, flat = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    mark = np.zeros(len(values), bool)
    # every pair from both ends, by the first
    a, b, far = np.r_[i, j], np.r_[j, i], np.r_[d, d]
    order = np.argsort(a, kind="stable")
    a, b, far = a[order], b[order], far[order]
    at = np.searchsorted(a, np.arange(n + 1))
    many = np.diff(at)
    mean = np.bincount(a, weights=far, minlength=n) / np.maximum(many, 1)
    comp, out, done = np.unique(label, return_inverse=True)[1], [], np.zeros(n, bool)
    for x in np.argsort(mean, kind="stable").tolist():
        if not many[x]:
            continue
        done[x] = True
        mine = flat[first[x] : first[x + 1]]
        mark[mine] = True
        mates = b[at[x] : at[x + 1]]
        mates = mates[~done[mates]]
        for lo in range(0, len(mates), 256):
            y = mates[lo : lo + 256]
            y = y[comp[y] != comp[x]]
            if not len(y):
                continue
            to = np.r_[0, np.cumsum(size[y])]
            hit = np.r_[0, np.cumsum(mark[flat[np.repeat(first[y] - to[:-1], size[y]) + np.arange(to[-1])]])]
            common = hit[to[1:]] - hit[to[:-1]]
            for z in y[(common > 0) & (common >= similarity * (size[x] + size[y] - common))].tolist():
                if comp[z] != comp[x]:
                    comp[comp == comp[z]] = comp[x]
                    out.append((x, z))
        mark[mine] = False
    return out


def unjoined_links(nodes: DataFrame, docs: DataFrame, masks: np.ndarray, radius: int, shingle: int, similarity: float, block: int = CHECK_BLOCK, piece: int = PIECE) -> DataFrame:
    """(a, b): links of at least that Jaccard similarity which join all labels that any pair within the radius joins.

    nodes: (id, fp, piece, label). A piece is a set of nodes connected within the radius. All pairs of a piece are
    compared up to `piece` nodes, by pairs of blocks; in a larger one those that share a bucket are.
    """
    wide = masks.shape[1]
    large = nodes.groupBy("piece").count().where(F.col("count") > piece).select("piece")
    fps = [F.col("fp")[w].alias(f"f{w}") for w in range(wide)]
    rows = nodes.join(large, "piece", "left_anti").select(F.xxhash64("piece").alias("key"), "id", *fps)
    rows = _dealt(c.kept(rows.unionByName(_keyed(nodes.join(large, "piece", "left_semi"), masks))), block)
    sets = shingle_sets(texts_of(docs, nodes.select("id")), shingle).withColumnRenamed("doc_id", "id")
    rows = rows.join(nodes.select("id", "label").join(sets, "id"), "id")

    def check(table: pa.Table) -> pa.Table:
        get = lambda k: table.column(k).to_numpy()
        ids, side, label = get("id"), get("side"), get("label")
        fp = np.stack([get(f"f{w}").view(np.uint64) for w in range(wide)], axis=1)
        i, j, d = links_within(np.zeros(len(ids), np.int64), fp, radius)
        apart = (label[i] != label[j]) & ((side[i] < 0) | (side[i] != side[j]))
        found = joining(i[apart], j[apart], d[apart], label, [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()], similarity)
        x, y = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(ids[x], pa.int64()), "b": pa.array(ids[y], pa.int64())})

    return rows.groupBy("task").applyInArrow(c.released(check), "a long, b long")


def text_key(text: str = "text"):
    """A text's node: 64 bits of its hash. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, recall: float = 0.97) -> DataFrame:
    """(doc_id, text_key, component_id, repeated): what has to go so that one row of every group of near copies stays.

    Rows are known by doc_id and text together: a doc_id's other texts are no concern of one that goes, and rows of a null
    doc_id take part like any other. The row that stays is of the smallest doc_id (null only where there is no other), of
    equal ids of the smaller key; component_id is its doc_id. Rows of a pair that is listed go; where repeated is true the
    pair stays, but only one of its rows.

    Near copies share a set of `shingle`-word shingles to at least `similarity` (Jaccard). Exact copies collapse first;
    128-bit fingerprints of the others are compared in buckets of sampled bits, as many as find a pair at just that
    similarity with that recall, and every link is checked on the sets themselves: the buckets' forests first, then all
    pairs within the radius whose ends these left apart. Two texts of one 64-bit key (a second hash tells) both stay.
    """
    named = docs.select(text_key().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key().alias("key"), F.xxhash64(F.lit(7), F.coalesce("text", F.lit(""))).alias("second"))
    pairs_of = c.kept(rows.groupBy("id", "key", "second").agg(F.count("*").alias("n")))  # equal rows are one from here on
    texts = c.kept(pairs_of.groupBy("key").agg(F.sum("n").alias("n"), F.min("id").alias("first"), (F.min("second") == F.max("second")).alias("one")))
    fp = lambda i: F.min(F.col("fp")[i])  # noqa: E731  copies have the same
    nodes = c.kept(fingerprints(named, shingle, wide=True).groupBy(F.col("doc_id").alias("id")).agg(F.array(fp(0), fp(1)).alias("fp")))
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    radius = math.ceil(128 * angle + 3.6 * math.sqrt(128 * angle * (1 - angle)))
    masks = sampled_keys(128, nodes.count(), angle, recall)
    pairs = c.kept(links(nodes, masks, radius))
    good = c.kept(similar(pairs, named, shingle, similarity))
    found = c.kept(components(good))
    of = lambda x: found.select(F.col("id").alias(x), F.col("component_id").alias(f"{x}_label"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_label, a) <> coalesce(b_label, b)")
    apart = c.kept(apart.select(F.col("a").alias("id")).distinct())
    if apart.limit(1).count():
        pieces = components(pairs).withColumnRenamed("component_id", "piece")
        pieces = c.kept(pieces.unionByName(pieces.select(F.col("piece").alias("id"), "piece")).distinct())  # components leaves the smallest id itself out
        pieces = pieces.join(pieces.join(apart, "id", "left_semi").select("piece").distinct(), "piece", "left_semi")
        left = nodes.join(pieces, "id").join(found, "id", "left").select("id", "fp", "piece", F.coalesce("component_id", "id").alias("label"))
        more = unjoined_links(c.kept(left), named, masks, radius, shingle, similarity)
        found = components(good.unionByName(c.kept(more)))

    texts = texts.join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("label", F.coalesce("component_id", "key")).where("one")
    stays = texts.groupBy("label").agg(F.sum("n").alias("rows"), F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "key")).alias("stay")).where("rows > 1")
    # every group's texts learn which row stays; copies of one text, however many, meet that in parts
    verdicts = texts.join(stays, "label").select("key", F.col("stay.id").alias("stay_id"), F.col("stay.key").alias("stay_key"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    rest = pairs_of.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")).join(verdicts, ["key", "part"])
    stay = (F.col("key") == F.col("stay_key")) & F.col("id").eqNullSafe(F.col("stay_id"))
    return rest.where(~stay | (F.col("n") > 1)).select(F.col("id").alias("doc_id"), F.col("key").alias("text_key"), F.col("stay_id").alias("component_id"), stay.alias("repeated"))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of every group of near copies, all others as they are; only rows that a bitmap of the verdicts holds back are
    shuffled, equal ones after they have become one."""
    gone = c.kept(near_duplicates(docs, **how))
    key, pair, flag = (c.unused(docs, x) for x in ("text_key", "text_pair", "maybe"))
    pair_of = lambda text, id_: F.xxhash64(text, F.col(id_).isNull(), F.coalesce(F.col(id_).cast("long"), F.lit(0).cast("long")))
    keyed = docs.withColumn(key, text_key()).withColumn(pair, pair_of(key, "doc_id"))
    marked = c.sieved(keyed, pair, gone.select(pair_of("text_key", "doc_id").alias("pair")), flag)
    held = marked.where(F.col(flag)).withColumn(pair, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))).withColumn(flag, F.col("doc_id").isNull())
    held = held.dropDuplicates([key, pair, flag])
    drop = gone.where("not repeated").select(F.col("text_key").alias(key), F.coalesce("doc_id", F.lit(0).cast("long")).alias(pair), F.col("doc_id").isNull().alias(flag))
    return marked.where(~F.col(flag)).unionByName(held.join(drop, [key, pair, flag], "left_anti").select(marked.columns)).select(docs.columns)
