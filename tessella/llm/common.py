"""Shared helpers of the training-data operators: shared storage, document groups, NumPy text kernels.

Whole texts are handled as UTF-8 byte arrays. A *group* is a set of documents of about ``GROUP_BYTES`` of text,
chosen by a hash of doc_id and text, that one task reads at a time; several passes over the same groups exchange compact
blocks of digests (sorted, distinct within the group), so a key that a third of all rows share costs one entry
per group and never gathers in one task.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_BYTES = 4 << 20
CHUNK_BYTES = 1 << 19
NO_ID = np.iinfo(np.int64).max

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where that is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_already.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = set_already.get() if set_already.isDefined() else f"file://{tempfile.mkdtemp(prefix='tessella-')}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _trim():
    """glibc's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def released(f):
    """f for one group; what its arrays took goes back to the system before the next group, or the next stage, comes."""

    def run(*args):
        try:
            return f(*args)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    # Spark tells the kinds of grouped functions apart by how many arguments they name
    return {1: lambda x: run(x), 2: lambda key, x: run(key, x), 3: lambda key, x, y: run(key, x, y)}[f.__code__.co_argcount]


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).head()[0] or 0


def in_groups(docs: DataFrame, total_bytes: int, rest: bool = False) -> DataFrame:
    """(g, doc_id, text): g spreads documents evenly over groups of about GROUP_BYTES, by doc_id and text, so that rows of a null
    or repeated doc_id lie in many groups. rest: all columns too, as a struct."""
    n = max(1, -(-total_bytes // GROUP_BYTES))
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        *([F.struct(*[docs[x] for x in docs.columns if x != "text"]).alias("rest")] if rest else []),
    )


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and the offset at which each row begins (one more at the end)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(c.cast(pa.large_string()) for c in col.chunks) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64, count=len(col) + 1, offset=8 * col.offset) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges [a, b) of at most `most` bytes, or of one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        yield a, b
        a = b


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+, and each row's first word (one more at the end)."""
    n = len(data)
    ink = np.zeros(n + 2, dtype=bool)
    np.logical_not(_SPACE[data], out=ink[1:-1])
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    starts = np.flatnonzero(ink[1:] & (~ink[:-1] | edge))
    ends = np.flatnonzero(ink[:-1] & (~ink[1:] | edge))
    return starts, ends, np.searchsorted(starts, offs)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial digests, modulo 2**64, of slices of a value sequence."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.code = rng.integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", inverse)):
                p = np.full(n, b, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, values: np.ndarray) -> np.ndarray:
        self._powers(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts])

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Digests of all slices of one length."""
        n = len(sums) - length
        return mix((sums[length:] - sums[:-length]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, roll: Rolling) -> np.ndarray:
    return roll.slices(roll.sums(roll.code[data]), starts, ends) + (ends - starts).astype(np.uint64)


def buckets(total: int, each: int) -> int:
    return max(1, -(-total // each))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket from the upper half of the digest, so that order by digest is order by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct digests in order, an order that sorts all, and where each distinct one begins in it."""
    order = np.argsort(h).astype(np.int32)
    s = h[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[head], order, head


def dealt_back(values: np.ndarray, order: np.ndarray, head: np.ndarray) -> np.ndarray:
    """A value per distinct digest, given to each of the digests that `distinct` sorted."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, np.diff(np.r_[head, len(order)]))
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n places lies in any of the ranges [start, end)."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


SIEVE_BITS = 1 << 22
_SIEVE_PAGE = 1 << 15


def sieved(df: DataFrame, id_col: str, ids: DataFrame, flag: str = "maybe") -> DataFrame:
    """df with a boolean that is true for every id of `ids` (and, by chance, for a few others).

    Ids are hashed into a bitmap of SIEVE_BITS bits, half a megabyte whatever their number, which is broadcast. What it
    lets through is checked by an exact join of its own; the rest of df, texts and all, need not be shuffled.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(SIEVE_BITS))
    page, at = (lambda c: F.floor(place(c) / _SIEVE_PAGE)), (lambda c: place(c) % _SIEVE_PAGE)
    pages = ids.select(page(ids.columns[0]).alias("_page"), at(ids.columns[0]).alias("_at")).groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    # the row travels as one struct, so no column of df clashes with those added here
    row = df.select(F.struct(*[df[x] for x in df.columns]).alias("_row"), page(id_col).alias("_page"), at(id_col).alias("_at"))
    out = row.join(F.broadcast(pages), "_page", "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return out.select(*[F.col(f"_row.`{x}`").alias(x) for x in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as df's columns make necessary."""
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of df whose id is not among `ids` (one column); only rows that the sieve holds back are shuffled."""
    flag = unused(df, "maybe")
    marked = sieved(df, id_col, ids, flag)
    checked = marked.where(F.col(flag)).join(ids.toDF(id_col), id_col, "left_anti")
    return marked.where(~F.col(flag)).unionByName(checked).select(df.columns)
