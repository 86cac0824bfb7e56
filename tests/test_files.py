"""File readers and writers, round trip."""

import io
import json
import sqlite3
import zipfile

import pytest
from millrace.sources import files, sinks
from pyspark.sql import functions as F


def test_klines(spark, tmp_path):
    def put(name, times):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("x.csv", "\n".join(f"{t},1,2,0.5,1.5,9,{t},1,1,1,1,0" for t in times))
        (tmp_path / name).write_bytes(b.getvalue())

    put("a.zip", [60_000, 120_000])
    put("b.zip", [180_000])
    assert [r["t"] for r in files.klines(spark, str(tmp_path / "*.zip"), 0, 1000).orderBy("t").collect()] == [60, 120, 180]
    put("b.zip", [240_000])
    with pytest.raises(ValueError):
        files.klines(spark, str(tmp_path / "*.zip"), 0, 1000)


def test_frames(spark, tmp_path):
    rows = [(k, 10**18 + k, k, "in", 1, b"m%d" % k) for k in range(5)]
    (tmp_path / "f.bin").write_bytes(files.frame_bytes(rows))
    d = files.frames(spark, str(tmp_path / "f.bin"))
    assert [(r["sequence"], r["wall_ns"], bytes(r["raw"])) for r in d.orderBy("sequence").collect()] == [(s, w, raw) for s, w, _, _, _, raw in rows]
    assert files.sequence_breaks(d).count() == 0 and files.sequence_breaks(d.where("sequence <> 2")).count() == 1


def test_minute_series(spark, tmp_path):
    for name, ts in (("a", [60, 120]), ("b", [120, 180])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"data": [{"t": t, "v": float(t)} for t in ts]}))
    assert files.minute_series(spark, str(tmp_path / "*.json")).count() == 3
    (tmp_path / "c.json").write_text(json.dumps({"data": [{"t": 120, "v": 1.0}]}))
    with pytest.raises(ValueError):
        files.minute_series(spark, str(tmp_path / "*.json"))


def test_sqlite_and_manifest(spark, tmp_path):
    c = sqlite3.connect(tmp_path / "a.db")
    c.execute("CREATE TABLE x (a INTEGER, b REAL)")
    c.executemany("INSERT INTO x VALUES (?, ?)", [(1, 1.5), (2, None)])
    c.commit()
    c.close()
    assert files.sqlite_rows(spark, str(tmp_path / "a.db"), "x", ["a", "b"], "a long, b double").count() == 2
    have = files.inventory(spark, str(tmp_path)).first()
    m = lambda sha: spark.createDataFrame([("a.db", have["length"], sha), ("z", 1, "0")], "name string, bytes long, sha256 string")
    assert {(r[0], r[1]) for r in files.verify_manifest(spark, str(tmp_path), m(have["sha256"])).collect()} == {("z", "missing")}
    assert {(r[0], r[1]) for r in files.verify_manifest(spark, str(tmp_path), m("1")).collect()} == {("a.db", "differs"), ("z", "missing")}


def test_pushdown_and_pruning(spark, tmp_path):
    p = str(tmp_path / "u")
    spark.createDataFrame([("a", "BTC", "5m", 60_001, 1.0, 0.07), ("b", "BTC", "15m", 60_000, 1.0, 0.07), ("c", "ETH", "5m", 999_000, 0.0, 0.07)], "condition_id string, asset string, duration string, market_start_ms bigint, outcome_up double, fee_rate double").write.parquet(p)
    u = files.universe(spark, p, ["BTC", "ETH"], 0, 100)
    assert [(r["condition_id"], r["market_start_s"]) for r in u.collect()] == [("a", 61)]
    assert "PushedFilters: [IsNotNull(market_start_ms)" in u._jdf.queryExecution().toString()


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 0, 1), ("b", 3600, 2)], "k string, market_start_s long, v int")
    at = str(tmp_path / "h")
    sinks.write_hours(d, at)
    sinks.write_hours(d.where("k = 'b'").withColumn("v", F.lit(9)), at)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(at).collect()) == [("a", 1), ("b", 9)]
    to = str(tmp_path / "rows")
    assert sinks.append_new(d, to, ["k"]) == 2 and sinks.append_new(d, to, ["k"]) == 0
    sinks.write_csv(d.withColumn("x", F.array("v")), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_json({"a": 1}, str(tmp_path / "j.json"))
    assert json.loads((tmp_path / "j.json").read_text()) == {"a": 1}
