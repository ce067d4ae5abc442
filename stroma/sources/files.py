"""Reading and writing files: tolerant projection, declared CSV schemas, archives, partitioned sinks."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stroma.sources.tables import ship_package


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """A Parquet scan of those of ``columns`` that exist; missing ones with a type in ``types`` come as NULL."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    there = set(df.columns)
    typed = types or {}
    return df.select(*[F.col(c) if c in there else F.lit(None).cast(typed[c]).alias(c) for c in columns if c in there or c in typed])


def read_csv(spark: SparkSession, path: str, schema: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """A CSV scan with a declared schema, so the files are read once; rows that don't fit it raise."""
    return spark.read.option("timestampNTZFormat", timestamp_format).csv(path, schema=schema, header=True, mode="FAILFAST", timestampFormat=timestamp_format)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Parquet by partition columns; rows are dealt by them first, in a number of files that adaptive execution sets."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).parquet(path)


def write_results(df: DataFrame, path: str, kind: str = "csv", compress: bool = False) -> None:
    """CSV (with header) or JSON lines, gzipped on demand."""
    writer = df.write.mode("overwrite").option("compression", "gzip" if compress else "none")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def scan_tars(spark: SparkSession, path: str, schema: str, keep: str | None = None, suffix: str = ".parquet", chunk_rows: int = 100_000) -> DataFrame:
    """Rows of all Parquet members of the tar files under ``path``, which may be of any size.

    First each archive's headers are read by seeking from one to the next; then each
    member is a row of its own, dealt over tasks, which read just its bytes. ``keep`` is a
    filter applied to the rows as they come. A member is held in memory by its task.
    """
    ship_package(spark)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content isn't read

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as file, tarfile.open(fileobj=file, mode="r:") as tar:
                    found = [(name, m.offset_data, m.size) for m in tar if m.isfile() and m.name.endswith(suffix)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "start", "size"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(name) as file:
                    file.seek(start)
                    body = file.read(size)
                yield from pq.ParquetFile(io.BytesIO(body)).iter_batches(chunk_rows, columns=names)

    listed = files.mapInArrow(headers, "path string, start long, size long")
    tasks = max(1, min(int(listed.count()), 10_000))
    found = listed.repartition(tasks, "path", "start").mapInArrow(members, schema)
    return found.where(keep) if keep else found


def _opened(path: str):
    """A seekable file of any file system that Arrow knows by its address."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub("^file:/+", "file:///", path))
    return system.open_input_file(inner)


def describe(df: DataFrame) -> DataFrame:
    """(column, type) of a table."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def register(df: DataFrame, name: str) -> DataFrame:
    """Makes ``df`` a relation that SQL of its session can name; replaces one of that name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def choose_source(raw: DataFrame, day: str, excluded: list[str], cleaned: DataFrame | None = None, more_excluded: list[str] | None = None) -> DataFrame:
    """The cleaned table if there is one, with its own further excluded days, else the raw one: the choice is an argument, never the environment's."""
    days = [*excluded, *(more_excluded or [])] if cleaned is not None else excluded
    chosen = raw if cleaned is None else cleaned
    return chosen.where(~F.col(day).isin([F.lit(d).cast("date") for d in days])) if days else chosen


def write_tensor(spark: SparkSession, path: str, arrays: dict[str, "np.ndarray"]) -> None:  # noqa: F821
    """Arrays of any shape as one Parquet row each: name, shape, values."""
    rows = [(k, [int(n) for n in a.shape], [float(x) for x in a.ravel()]) for k, a in arrays.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def read_tensor(spark: SparkSession, path: str) -> dict:
    """What ``write_tensor`` wrote; as large as the driver's memory allows, like the arrays themselves."""
    import numpy as np

    return {r["name"]: np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}
