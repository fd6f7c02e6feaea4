"""Source divergence audit: how far each source's use of terms lies from the other sources' and from its language's.

Terms are runs of letters A-Z, a-z and characters beyond ASCII, only A-Z lower-cased. A language keeps the terms that at
least MIN_DOCS of its documents (rows) hold. A group's share of a term is 1 + floor(SCALE * (count + SMOOTHING) / (N +
SMOOTHING * V)), in whole numbers throughout.

* Counts: each task sums terms over the documents that it reads and hands on one row per group and term, so a source that
  holds a third of all rows costs one row a task and term. Sums of a group are joined back salted.
* Divergence of two sources: the sum over all V terms is V * |b - b'| for the shares b, b' of an absent term, corrected by
  what each source's own terms change (through a histogram of its shares) and, for terms that both use, by what the two
  corrections count wrongly. Only terms in use are visited; a task adds up a matrix for the terms it holds.
* Ranking: `radix_top` finds each group's kth value from histograms over its bits, ten at a time, and where too many rows tie
  there, the bytes of the kth item, one at a time. What is left to sort is k rows and at most `few` ties a group.

Null text, lang and source count as ''. Repeated rows are documents of their own. A group without terms, an empty text and a
language without kept terms give pairs of value 0 and no terms; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
TERM = re.compile(rb"[a-z\x80-\xff]+")
SALTS = 16
HELD_TERMS = 1 << 18
LONG_TEXT = 1 << 20
CELLS = 1 << 20


def _count_terms(batches):
    """(lang, source, term, n, docs) of the documents of one task, summed until HELD_TERMS entries are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def summed():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(terms), pa.string()), "source": pa.array([source] * len(terms), pa.string()), "term": pa.array([t.decode() for t in terms], pa.string()),
                "n": pa.array([n[t] for t in terms], pa.int64()), "docs": pa.array([docs[t] for t in terms], pa.int64()),
            })
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text"))):
            lower = text.lower()  # of bytes: A-Z alone
            found = Counter(TERM.findall(lower) if len(lower) < LONG_TEXT else (m.group() for m in TERM.finditer(lower)))
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(found)
            docs.update(found.keys())
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from summed()
    yield from summed()


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[x].cast("string"), F.lit("")).alias(x) for x in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, total, lead): occurrences in the source and the language; lead marks one row of each (lang, term)."""
    c = _read(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    c = c.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")
    c = c.select("*", F.sum("docs").over(of).alias("df"), F.sum("n").over(of).alias("total"), (F.row_number().over(of.orderBy("source")) == 1).alias("lead"))
    return c.where(F.col("df") >= min_docs).drop("df", "docs")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (n + SMOOTHING * v)), exact; null where there are no terms."""
    whole = lambda x: x.cast("decimal(20,0)")
    top, below = whole(F.lit(SCALE)) * whole(count + SMOOTHING), whole(n + SMOOTHING * v)
    return 1 + F.call_function("div", top, F.nullif(below, whole(F.lit(0))))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """rows joined with `groups` on keys. Each group's rows go to SALTS tasks by `spread`, so no group is one task's."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"]).drop("_salt")


def group_sizes(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, n, lang_n, v, base): every group of the documents, its occurrences of kept terms, its language's, the
    number of kept terms, and the share of a term that the group lacks."""
    n = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v = terms.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("lead").alias("v"))
    g = _read(docs).select("lang", "source").distinct().join(n, ["lang", "source"], "left").join(v, "lang", "left").na.fill(0)
    return g.withColumn("base", F.coalesce(share(F.lit(0), F.col("n"), F.col("v")), F.lit(0)))


def _both(batches):
    """(lang, source, item, value): over the terms that both sources use, |p - p'| - |p - b'| - |b - p'| + |b - b'|."""
    sums: Counter = Counter()

    def rows():
        at = list(sums)
        yield pa.RecordBatch.from_pydict({
            **{x: pa.array([k[i] for k in at], pa.string()) for i, x in enumerate(("lang", "source", "item"))}, "value": pa.array([sums[k] for k in at], pa.int64()),
        })
        sums.clear()

    for batch in batches:
        uses = batch.column("uses")
        flat = uses.flatten()
        term = np.repeat(np.arange(len(uses)), uses.value_lengths().to_numpy(zero_copy_only=False))
        source, p, base = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("base").to_numpy()
        names, code = source.dictionary.to_pylist(), source.indices.to_numpy()
        lang = batch.column("lang").dictionary_encode()
        of_term = lang.indices.to_numpy()
        for i, name in enumerate(lang.dictionary.to_pylist()):
            mine = np.flatnonzero(of_term[term] == i)
            here, col = np.unique(code[mine], return_inverse=True)
            known, row = np.unique(term[mine], return_inverse=True)
            b = np.zeros(len(here), np.int64)
            b[col] = base[mine]
            step = max(1, CELLS // len(here))
            total = np.zeros((len(here), len(here)), np.int64)
            for a in range(0, len(known), step):
                part = (row >= a) & (row < a + step)
                share_of, has = np.zeros((min(step, len(known) - a), len(here)), np.int64), np.zeros((min(step, len(known) - a), len(here)), bool)
                share_of[row[part] - a, col[part]], has[row[part] - a, col[part]] = p[mine[part]], True
                for s in range(len(here)):
                    both, other = has[has[:, s]], share_of[has[:, s]]
                    own = other[:, s : s + 1]
                    total[s] += ((np.abs(own - other) - np.abs(own - b) - np.abs(b[s] - other) + np.abs(b[s] - b)) * both).sum(0)
            for x, y in zip(*np.nonzero(total)):
                if x != y:
                    sums[name, names[here[x]], names[here[y]]] += int(total[x, y])
        if len(sums) > CELLS:
            yield from rows()
    yield from rows()


def divergences(terms: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sum over all kept terms of |p - q| for every two sources of a language, both ways.

    terms: (lang, source, term, p, base)."""
    other = sizes.select("lang", F.col("source").alias("item"), F.col("base").alias("other"))
    gap = F.abs(F.col("base") - F.col("other"))
    absent = with_groups(sizes.select("lang", "source", "v", "base"), other, ["lang"], ["source"]).where("source <> item").select("lang", "source", "item", (F.col("v") * gap).alias("value"))
    shares = terms.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("terms"))
    own = with_groups(shares, other, ["lang"], ["source", "p"]).where("source <> item")
    own = own.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("other")) - gap)).alias("value"))
    swapped = own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    uses = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "base")).alias("uses"))
    both = uses.select("lang", "uses").mapInArrow(_both, "lang string, source string, item string, value long")
    return absent.unionByName(own).unionByName(swapped).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def radix_top(rows: DataFrame, keys: list[str], k: int, bits: int = 30, few: int = 4096) -> DataFrame:
    """The k rows of greatest value (at least 0, under 2**bits) of every group, with their rank; ties to the least item by UTF-8 bytes.

    rows: keys, item (string, distinct in a group), value (long). It is read once for every ten bits and for every byte that
    ties need, each time for a histogram summed in the tasks that read; it should be a stored table.
    """
    width = 10
    of = Window.partitionBy(*keys)
    state = None
    for shift in range(-(-bits // width) * width - width, -1, -width):
        at = rows.select(*keys, F.shiftright("value", shift + width).alias("high"), F.shiftright("value", shift).bitwiseAND((1 << width) - 1).alias("digit"), "item")
        if state is None:
            h = at.groupBy(*keys, "digit").agg(F.count("*").alias("n")).withColumn("chosen", F.lit(0)).withColumn("need", F.least(F.lit(k), F.sum("n").over(of)))
        else:
            h = with_groups(at, state, keys, ["item"]).where("high = chosen").groupBy(*keys, "chosen", "need", "digit").agg(F.count("*").alias("n"))
        h = h.withColumn("upto", F.sum("n").over(of.orderBy(F.desc("digit")))).where("upto >= need and upto - n < need")
        state = h.select(*keys, (F.col("chosen") * (1 << width) + F.col("digit")).cast("long").alias("chosen"), (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("ties"))
    state = kept(state.withColumn("prefix", F.lit("").cast("binary")))
    size = 0
    while (state.agg(F.max(F.when(F.col("ties") > F.col("need"), F.col("ties")))).head()[0] or 0) > few:
        size += 1
        tied = with_groups(rows, state, keys, ["item"]).where("value = chosen").withColumn("start", F.substring(F.col("item").cast("binary"), 1, size))
        tied = tied.where(F.substring("start", 1, size - 1) == F.col("prefix")) if size > 1 else tied
        h = tied.groupBy(*keys, "chosen", "need", "start").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(of.orderBy("start"))).where("upto >= need and upto - n < need")
        state = kept(h.select(*keys, "chosen", (F.col("need") - F.col("upto") + F.col("n")).alias("need"), F.col("n").alias("ties"), F.col("start").alias("prefix")))
    near = with_groups(rows, state, keys, ["item"])
    start = F.substring(F.col("item").cast("binary"), 1, size) if size else F.lit("").cast("binary")
    near = near.where((F.col("value") > F.col("chosen")) | ((F.col("value") == F.col("chosen")) & (start <= F.col("prefix"))))
    ranked = near.select(*keys, "item", "value", F.row_number().over(of.orderBy(F.desc("value"), "item")).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language, part `term` the terms
    that the source uses more than its language does."""
    counted = kept(kept_terms(docs, min_docs))
    sizes = kept(group_sizes(docs, counted))
    c = lambda x: F.col(x)
    terms = with_groups(counted, sizes.withColumnRenamed("n", "group_n"), ["lang", "source"], ["term"])
    terms = kept(terms.select("lang", "source", "term", "base", share(c("n"), c("group_n"), c("v")).alias("p"), share(c("total"), c("lang_n"), c("v")).alias("q")))
    group = ["lang", "source"]
    pairs = divergences(terms, sizes).withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item")))
    over = kept(terms.where("p > q").select(*group, F.col("term").alias("item"), (c("p") - c("q")).alias("value")))
    found = radix_top(over, group, top)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(found.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
