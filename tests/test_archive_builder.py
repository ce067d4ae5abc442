"""Archives as a data source with conditions on statistics; tables that are built in runs."""

from __future__ import annotations

import io
import json
import tarfile
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stroma.sources import archive, builder
from stroma.sources.archive import Part, TarReader, TarSource

SCHEMA = "k long, v string, extra double"


@pytest.fixture(scope="module")
def tars(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tars")
    for a in range(2):
        with tarfile.open(folder / f"a{a}.tar", "w") as tar:
            for m in range(3):
                first = (a * 3 + m) * 1000
                body = io.BytesIO()
                pq.write_table(pa.table({"k": pa.array(range(first, first + 1000), pa.int64()), "v": [f"v{k % 7}" for k in range(1000)], "unused": ["x" * 50] * 1000}), body, row_group_size=100)
                info = tarfile.TarInfo(f"day{m}.parquet")
                info.size = len(body.getvalue())
                tar.addfile(info, io.BytesIO(body.getvalue()))
            note = tarfile.TarInfo("note.txt")
            note.size = 4
            tar.addfile(note, io.BytesIO(b"note"))
    (folder / "other.bin").write_bytes(b"no tar")
    return folder


def test_rows_of_all_members(spark, tars):
    df = archive.read_tars(spark, str(tars), SCHEMA)
    assert df.rdd.getNumPartitions() == 6
    got = df.where("k >= 2950 and k < 3050 and v = 'v1'").collect()
    assert Counter(r.k for r in got) == Counter(k for k in range(2950, 3050) if k % 1000 % 7 == 1) and all(r.extra is None for r in got)
    assert df.count() == 6000  # a filter of one use isn't kept for the next
    assert archive.read_tars(spark, str(tars / "a0.tar"), "k long").count() == 3000


def test_conditions_choose_rows(spark, tars):
    df = archive.read_tars(spark, str(tars), SCHEMA, [("k", ">", 1234), ("k", "<=", 1450), ("v", "in", ["v1", "zz"])])
    assert Counter(r.k for r in df.collect()) == Counter(k for k in range(1235, 1451) if k % 1000 % 7 == 1)
    assert archive.read_tars(spark, str(tars), SCHEMA, [("extra", "=", 1.0)]).count() == 0


def test_statistics_leave_out_groups_and_columns(tars, monkeypatch):
    schema = StructType([StructField("k", LongType()), StructField("v", StringType())])
    read = []
    real = Part.read
    monkeypatch.setattr(Part, "read", lambda self, size=-1: read.append(len(x := real(self, size))) or x)

    def rows_and_bytes(conditions):
        read.clear()
        one = TarReader({"path": str(tars), "conditions": json.dumps(conditions)}, schema)
        return [sum(b.num_rows for b in one.read(m)) for m in one.partitions()], sum(read)

    rows, pruned = rows_and_bytes([("k", ">", 1234), ("k", "<=", 1450), ("v", "in", ["v1", "zz"])])
    none, footers = rows_and_bytes([("k", ">", 10**9)])
    whole, everything = rows_and_bytes([])
    assert sorted(rows) == [0, 0, 0, 0, 0, 300] and sum(none) == 0 and sum(whole) == 6000
    assert pruned - footers < 0.1 * (everything - footers)
    assert sum(rows_and_bytes([("k", ">", "text")])[0]) == 6000


def test_a_member_is_read_in_row_groups(tars):
    """No batch is larger than a row group, whatever the member's size."""
    reader = TarSource({"path": str(tars), "batch_rows": "40"}).reader(StructType([StructField("k", LongType())]))
    sizes = [b.num_rows for b in reader.read(reader.partitions()[0])]
    assert sum(sizes) == 1000 and max(sizes) <= 40


def test_no_archives(spark, tmp_path):
    assert archive.read_tars(spark, str(tmp_path), SCHEMA).count() == 0


DAYS = "day string, n long"


def days(spark, rows):
    return spark.createDataFrame(rows, DAYS)


def test_a_rerun_replaces_its_days(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    assert builder.read(spark, path, DAYS).count() == 0
    first = [("d1", 1), ("d1", 2), ("d2", 3), ("a/b=c", 4)]
    assert builder.build(days(spark, first), path, "day") == 1
    assert Counter(map(tuple, builder.read(spark, path, DAYS).collect())) == Counter(first)
    assert builder.build(days(spark, [("d2", 30), ("d3", 5)]), path, "day") == 2
    now = Counter([("d1", 1), ("d1", 2), ("d2", 30), ("d3", 5), ("a/b=c", 4)])
    assert Counter(map(tuple, builder.read(spark, path, DAYS).collect())) == now
    assert builder.build(days(spark, [("d2", 30), ("d3", 5)]), path, "day") == 3
    assert Counter(map(tuple, builder.read(spark, path, DAYS).collect())) == now
    assert builder.build(days(spark, []), path, "day", only=["d1"]) == 4
    assert {r.day for r in builder.read(spark, path, DAYS).collect()} == {"d2", "d3", "a/b=c"}
    assert [r.n for r in builder.read(spark, path, DAYS, parts=["d3"]).collect()] == [5]
    assert {p: x["rows"] for p, x in builder.manifest(spark, path)[1].items()} == {"d2": 1, "d3": 1, "a/b=c": 1}
    assert builder.vacuum(spark, path) == 2 and builder.read(spark, path, DAYS).count() == 3


def test_a_failed_run_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    builder.build(days(spark, [("d1", 1)]), path, "day")
    with pytest.raises(Exception, match="without day"):
        builder.build(days(spark, [("d1", 9), (None, 2)]), path, "day")
    assert [tuple(r) for r in builder.read(spark, path, DAYS).collect()] == [("d1", 1)] and builder.manifest(spark, path)[0] == 1


def test_of_two_runs_at_once_one_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/table"
    builder.build(days(spark, [("d1", 1)]), path, "day")
    version, parts = builder.manifest(spark, path)
    builder.build(days(spark, [("d2", 2)]), path, "day")
    monkeypatch.setattr(builder, "manifest", lambda *_: (version, parts))
    with pytest.raises(builder.Conflict):
        builder.build(days(spark, [("d3", 3)]), path, "day")
    monkeypatch.undo()
    assert {r.day for r in builder.read(spark, path, DAYS).collect()} == {"d1", "d2"}
