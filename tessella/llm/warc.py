"""Operator 2: a dictionary-compressed WARC writer and its reader.

Records of one task are gathered into archives of about `ARCHIVE_BYTES`. Each archive trains a Zstandard dictionary on
its own records, stores it in a leading skippable frame (magic 0x184D2A5D), and holds every record as a frame of its own,
compressed with that dictionary, so that single records stay readable at their offset. Of records with equal payloads of
at least `REVISIT_BYTES` bytes, the one of the smallest page_id is a response and the others are revisits that name it.

Archives are written to the shared folder under names that no other attempt uses; a manifest of the attempts that
succeeded names the archives that count, so retried or lost tasks leave nothing behind that is read.

Edge cases: null html is an empty payload; equal payloads under the size are all responses; rows that repeat the smallest
page_id of a payload are all responses; a null page_id can only be a revisit or a response, never the one referred to
unless all its copies are null too; very long pages are archives of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

ARCHIVE_BYTES = 12 << 20
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 100 * DICTIONARY_BYTES
REVISIT_BYTES = 100
LEVEL = 3
STEP = 32 << 10
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').encode('unicode_escape').decode()}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from an archive's records, evenly spaced ones where they pass TRAIN_BYTES."""
    total = sum(map(len, records))
    sample = records[:: max(1, -(-total // TRAIN_BYTES))]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8, level=LEVEL)
    except zstandard.ZstdError:  # too few records to train on: their bytes are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """The whole file: the dictionary's skippable frame, then one frame a record."""
    dictionary = train(records)
    raw = dictionary.as_bytes()
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(raw)), raw, *map(pack.compress, records)])


def read_archive(data: bytes):
    """Headers (a dict) and block of every record."""
    data = memoryview(data)
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive begins with its dictionary")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    at, unpack = 8 + size, zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            parts.append(frame.decompress(data[at : at + STEP]))
            at += len(data[at : at + STEP])
        at -= len(frame.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _write(folder: str):
    def f(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)

        def put(records):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}.part") as out:
                out.write(archive(records))
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "records": [len(records)]})

        held, size = [], 0
        for batch in batches:
            cols = [batch.column(x) for x in ("page_id", "url", "payload", "digest", "first_id", "revisit")]
            for i in range(len(batch)):
                page_id, url, payload, digest, first, revisit = (x[i].as_py() for x in cols)
                held.append(warc_record(page_id, url, payload, digest, first, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    return f


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as archives into `folder`; returns the manifest (name, records)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    many = rows.where(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.join(many, "digest", "left").withColumn("revisit", revisit)
    return c.kept(rows.mapInArrow(_write(folder), "name string, records long"))


def _parse(batches):
    for batch in batches:
        for data in batch.column("content"):
            out = []
            for headers, block in read_archive(data.as_py()):
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                    raise ValueError(f"{headers['WARC-Record-ID']}: the block does not have its digest")
                number = lambda k: int(x) if (x := headers.get(k, "")[len("<urn:page:") : -1]) else None
                out.append((number("WARC-Record-ID"), headers["WARC-Target-URI"], int(headers["WARC-Payload-Length"]), digest, kind, number("WARC-Refers-To"), block))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _TYPES)], _NAMES)


_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "block"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block) of all records of the manifest."""
    spark = manifest.sparkSession
    if manifest.limit(1).count() == 0:
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select("name"), "name", "left_semi")
    return files.select("content").mapInArrow(_parse, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block binary")


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    folder = f"{c.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(folder, write_archives(pages, folder, revisit_bytes))
