"""Tables built day by day: a rerun replaces the days it made, and a failed one leaves the table as it was.

Each run writes Parquet into a folder of its own. A manifest, one small file a version, names for
each part (day) the run that holds it; it's written last, under the next number, and
never over another one. Readers take the newest manifest, so they see a run whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another run was committed since this one began."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, dict]]:
    """(version, part -> run, rows) of the newest manifest; version 0 if there is none. One entry a part."""
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return 0, {}
    versions = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")]
    if not versions:
        return 0, {}
    stream = fs.open(_fs(spark, f"{path}/manifests/{max(versions):010d}.json")[1])
    try:
        body = bytes(stream.readAllBytes())
    finally:
        stream.close()
    return max(versions), json.loads(body)["parts"]


def _commit(spark: SparkSession, path: str, version: int, parts: dict[str, dict], schema: str) -> None:
    fs, target = _fs(spark, f"{path}/manifests/{version:010d}.json")
    if fs.exists(target):
        raise Conflict(f"version {version} of {path} exists")
    _, draft = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"schema": json.loads(schema), "parts": parts}, sort_keys=True).encode()))
    out.close()
    if not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {version} of {path} exists")


def build(rows: DataFrame, path: str, part: str, only: list[str] | None = None) -> int:
    """Writes ``rows`` as the parts (values of ``part`` as text) that they have, in place of the same parts of earlier runs; gives the new version.

    Parts of ``only`` without rows become empty; others keep what they hold. Rows of a null
    part raise. Spark writes the files by part; the driver gets a count a part.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    version, parts = manifest(spark, path)
    named = rows.withColumn("_part", F.col(part).cast("string"))
    checked = named.withColumn("_part", F.when(F.col("_part").isNull(), F.raise_error(F.lit(f"a row without {part}"))).otherwise(F.col("_part")))
    checked.hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{path}/runs/{run}")
    written = spark.read.schema("_part string").option("basePath", f"{path}/runs/{run}").parquet(f"{path}/runs/{run}")
    counts = {r["_part"]: r["count"] for r in written.groupBy("_part").count().collect()}
    parts = {p: x for p, x in parts.items() if p not in (only or [])} | {p: {"run": run, "rows": n} for p, n in counts.items()}
    _commit(spark, path, version + 1, parts, rows.schema.json())
    return version + 1


def read(spark: SparkSession, path: str, schema: str, parts: list[str] | None = None) -> DataFrame:
    """The table's newest version, or of it the given parts alone: only their folders are read."""
    _, held = manifest(spark, path)
    folders = [f"{path}/runs/{x['run']}/_part={_escaped(spark, p)}" for p, x in sorted(held.items()) if parts is None or p in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _escaped(spark: SparkSession, part: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the runs that the newest manifest doesn't name; gives their number. Only while no run is being written."""
    fs, folder = _fs(spark, f"{path}/runs")
    used = {x["run"] for x in manifest(spark, path)[1].values()}
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in used] if fs.exists(folder) else []
    for g in gone:
        fs.delete(g, True)
    return len(gone)
