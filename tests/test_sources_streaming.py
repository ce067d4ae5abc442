from __future__ import annotations

import datetime as dt
import tarfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stroma.sources import files
from stroma.streaming import twins

T0 = dt.datetime(2024, 1, 1)


def test_tolerant_projection_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "x int, k string, ts timestamp_ntz")
    files.write_partitioned(df, f"{tmp_path}/p", ["k"])
    got = files.read_parquet(spark, f"{tmp_path}/p", ["x", "missing", "gone"], {"missing": "double"})
    assert got.columns == ["x", "missing"] and got.count() == 2
    files.write_results(df, f"{tmp_path}/c", "csv")
    back = files.read_csv(spark, f"{tmp_path}/c", "x int, k string, ts timestamp_ntz", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    assert sorted(r.x for r in back.collect()) == [1, 2]
    files.write_results(df, f"{tmp_path}/j", "json", compress=True)
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    assert [r["column"] for r in files.describe(df).collect()] == ["x", "k", "ts"]


def test_tar_members(spark, tmp_path):
    for k in range(2):
        pq.write_table(pa.table({"x": pa.array([k, k + 10], pa.int64()), "y": ["a", "b"]}), tmp_path / f"d{k}.parquet")
    with tarfile.open(tmp_path / "all.tar", "w") as tar:
        for k in range(2):
            tar.add(tmp_path / f"d{k}.parquet", f"days/d{k}.parquet")
    got = files.scan_tars(spark, f"{tmp_path}/all.tar", "x long", keep="x >= 10")
    assert sorted(r.x for r in got.collect()) == [10, 11]


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "k string, id long, ts timestamp, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema("k string, id long, ts timestamp, v double").parquet(f"{tmp_path}/in")


def collected(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


ROWS = [("a", k, T0 + dt.timedelta(minutes=m), float(k)) for k, m in enumerate([0, 5, 20, 36, 300, 900])] + [("a", 0, T0, 0.0)]


def test_streaming_twins(spark, tmp_path):
    assert len(collected(spark, twins.first_per_key(stream(spark, tmp_path / "a", ROWS), ["k", "id"], "ts", "1 hour"), "first")) == 6
    grid = collected(spark, twins.tumbling_state(stream(spark, tmp_path / "b", ROWS), "k", "ts", "v", 15, "10 minutes"), "tumbling")
    assert sum(r.n for r in grid) >= 5 and all(r.window.minute % 15 == 0 for r in grid)
    latest = collected(spark, twins.latest_per_key(stream(spark, tmp_path / "d", [*ROWS, ("b", 9, T0, 9.0), ("b", 8, T0, 8.0)]), ["k"], "ts", "id"), "latest", "update")
    assert {(r.k, r.id, r.v) for r in latest} == {("a", 5, 5.0), ("b", 9, 9.0)}
    found = collected(spark, twins.sessions(stream(spark, tmp_path / "c", ROWS), ["k"], "ts", 15, "10 minutes"), "sessions")
    by = {r.first_ts.replace(tzinfo=None): r for r in found}
    assert by[T0].n == 4 - 0 and by[T0].last_ts.replace(tzinfo=None) == T0 + dt.timedelta(minutes=20)


def test_session_gap_agrees_with_batch(spark):
    rows = [("a", T0), ("a", T0 + dt.timedelta(minutes=15)), ("a", T0 + dt.timedelta(minutes=30, seconds=1))]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    assert df.groupBy(F.session_window("ts", "15 minutes"), "k").count().count() == 2


def test_tensors_come_back(spark, tmp_path):
    import numpy as np

    arrays = {"a": np.arange(12.0).reshape(2, 3, 2), "b": np.zeros((0, 4))}
    files.write_tensor(spark, f"{tmp_path}/t", arrays)
    back = files.read_tensor(spark, f"{tmp_path}/t")
    assert all(np.array_equal(back[k], a) for k, a in arrays.items())


def test_the_source_is_an_argument(spark):
    df = spark.createDataFrame([("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-03", 3)], "d string, x int").withColumn("d", F.col("d").cast("date"))
    assert [r.x for r in files.choose_source(df, "d", ["2024-01-01"]).orderBy("x").collect()] == [2, 3]
    assert [r.x for r in files.choose_source(df, "d", ["2024-01-01"], df.where("x < 3"), ["2024-01-02"]).collect()] == []
    assert files.register(df, "stroma_test_relation").count() == 3 and spark.sql("SELECT sum(x) AS s FROM stroma_test_relation").first().s == 6
