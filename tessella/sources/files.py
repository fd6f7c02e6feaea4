"""Files: delimited text, JSON lines, zipped text and Parquet, each with a fixed schema, and where written tables go."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return path or f"file://{tempfile.mkdtemp(prefix='tessella-')}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Delimited text, bad fields null; `path` may be a glob. A column `file` names each row's file."""
    return spark.read.csv(path, schema=schema, header=header, mode="PERMISSIVE").withColumn("file", F.col("_metadata.file_name"))


def read_returns(spark: SparkSession, path: str, need: int = 30) -> DataFrame:
    """(run_id, dt, r) of a folder of return files, one run a file (its name less the ending); runs under `need` finite rows are left out."""
    d = read_csv(spark, path, "dt string, r string")
    d = d.select(F.regexp_replace("file", r"\.csv(\.gz)?$", "").alias("run_id"), F.to_date("dt").alias("dt"), F.expr("try_cast(r AS double)").alias("r"))
    d = d.where("dt is not null and r is not null and not isnan(r) and abs(r) < double('infinity')")
    return d.join(d.groupBy("run_id").count().where(F.col("count") >= need).select("run_id"), "run_id", "left_semi")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are not JSON are dropped, bare NaN and Infinity become null."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(?<=[:\[,])\s*(NaN|-?Infinity)\s*(?=[,}\]])", "null").alias("value"))
    d = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x")).select("x.*")
    return d.where("_bad is null").drop("_bad")


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], batch_rows: int = 50_000) -> DataFrame:
    """(file, member, columns as strings): delimited text inside zip archives, one archive a task, read as a stream."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["file", "member", *columns]

    def f(batches):
        for batch in batches:
            for p, raw in zip(batch.column("path").to_pylist(), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(raw.as_py())) as z:
                    for member in sorted(z.namelist()):
                        held = []
                        with z.open(member) as one:
                            for row in csv.DictReader(io.TextIOWrapper(one, "utf-8")):
                                held.append((p.rpartition("/")[2], member, *(row.get(c) for c in columns)))
                                if len(held) == batch_rows:
                                    yield _batch(held, names)
                                    held = []
                        if held:
                            yield _batch(held, names)

    return files.mapInArrow(f, ", ".join(f"{c} string" for c in names))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names)


def as_of(df: DataFrame, last: str, first: str | None = None, on: str = "dt") -> DataFrame:
    """Rows up to a date (and from one); both bounds are pushed to the scan."""
    d = df.where(F.col(on) <= F.lit(last).cast("date"))
    return d.where(F.col(on) >= F.lit(first).cast("date")) if first else d
