"""Manifests of stored files: what a folder holds, byte for byte, and whether it still does."""

from __future__ import annotations

import _hashlib
import ctypes
import functools
import hashlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import new_path

WHOLE, PIECE, BLOCK = 64 << 20, 256 << 20, 8 << 20


def manifest(spark: SparkSession, root: str, pattern: str = "*", whole: int = WHOLE, piece: int = PIECE) -> DataFrame:
    """(path, bytes, sha256) of every file under root whose name fits the pattern, path relative to root.

    Files of up to `whole` bytes are read by Spark's binary source, one a row; that source passes over empty files and folders. Larger ones are read
    piece by piece: a digest has to be taken in order, so a task reads one piece of a file, in blocks, and hands the digest's
    state, of some hundred bytes, to the task of the next piece. Pieces of different files are read side by side.
    """
    inside = root.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    told = lambda d, sha256: d.select(F.substring_index("path", inside, -1).alias("path"), F.col("length").alias("bytes"), sha256.alias("sha256"))
    small = told(files.where(F.col("length") <= whole), F.sha2("content", 256))
    most = files.where(F.col("length") > whole).agg(F.max("length"), F.count("*")).head()
    if not most[1]:
        return small
    piece = piece if _libcrypto() else most[0]
    state = files.where(F.col("length") > whole).select("path", "length", F.lit(None).cast("binary").alias("state"))
    for at in range(0, most[0], piece):
        here = new_path(spark, "digests")
        state.repartitionByRange(most[1], "path").mapInArrow(_digested(at, piece), "path string, length long, state binary").write.parquet(here)
        state = spark.read.schema("path string, length long, state binary").parquet(here)
    return small.unionByName(told(state, F.lower(F.hex("state"))))


@functools.cache
def _libcrypto():
    """The library of Python's own hashes, whose SHA-256 can be put down and taken up again; None where it hides these functions."""
    lib = ctypes.CDLL(_hashlib.__file__)
    return lib if all(hasattr(lib, f"SHA256_{x}") for x in ("Init", "Update", "Final")) else None


def _blocks(path: str, at: int, end: int):
    where, path = (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith(("file:", "/")) else fs.FileSystem.from_uri(path)
    with where.open_input_file(path) as f:
        f.seek(at)
        while at < end:
            block = f.read(min(BLOCK, end - at))
            if not block:
                raise EOFError(f"{path} ends at {at}, before {end}")
            yield block
            at += len(block)


def _digest(path: str, length: int, at: int, piece: int, state: bytes | None) -> bytes:
    """The state after the piece of the file that begins at `at`; after its last piece, the digest."""
    if at >= length:
        return state
    end, lib = min(length, at + piece), _libcrypto()
    if at == 0 and end == length:
        whole = hashlib.sha256()
        for block in _blocks(path, at, end):
            whole.update(block)
        return whole.digest()
    kept = ctypes.create_string_buffer(state or bytes(112), 112)  # struct SHA256_CTX
    if at == 0:
        lib.SHA256_Init(kept)
    for block in _blocks(path, at, end):
        lib.SHA256_Update(kept, ctypes.c_char_p(block), ctypes.c_size_t(len(block)))
    if end < length:
        return kept.raw
    out = ctypes.create_string_buffer(32)
    lib.SHA256_Final(out, kept)
    return out.raw


def _digested(at: int, piece: int):
    def run(batches):
        for b in batches:
            path, length = b.column("path").to_pylist(), b.column("length").to_pylist()
            state = [_digest(p, n, at, piece, s) for p, n, s in zip(path, length, b.column("state").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(state, pa.binary())], ["path", "length", "state"])

    return run


def snapshot_sha256(files: DataFrame) -> DataFrame:
    """(files, snapshot_sha256): one digest of a manifest: of its lines, `sha256`, two blanks and the path, in order of the path.

    A manifest is a line a file; the lines, not the files, meet in one row."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("  "), x["path"]))
    return files.agg(F.count("*").alias("files"), F.sha2(F.array_join(lines, "\n"), 256).alias("snapshot_sha256"))


def differences(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, finding): files of two manifests that differ: missing, added or changed; none where both are the same."""
    d = recorded.select("path", F.col("sha256").alias("a")).join(found.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    finding = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return d.select("path", finding.alias("finding")).where("finding is not null")
