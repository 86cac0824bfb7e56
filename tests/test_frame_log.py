"""Frame logs as a data source: ranges, rotation, append, streams, damage."""

import gzip
import os

import pytest
from millrace.sources import files, frame_log
from millrace.streaming import feeds

HOUR = frame_log.HOUR_NS


@pytest.fixture
def log(spark, tmp_path):
    frame_log.register(spark)
    return str(tmp_path / "log")


def rows(first, n, start=5 * HOUR, step=HOUR // 1000):
    return [(k, start + (k - first) * step, k * 7, "in" if k % 3 else "out", k % 5, bytes([k % 256]) * (k % 40)) for k in range(first, first + n)]


def put(spark, log, data, mode="append", parts=3):
    df = spark.createDataFrame(data, frame_log.SCHEMA)
    df = df.repartitionByRange(parts, "sequence").sortWithinPartitions("sequence") if data else df
    df.write.format("frame_log").option("blockFrames", 100).mode(mode).save(log)


def get(spark, log):
    return sorted((r["sequence"], r["wall_ns"], r["monotonic_ns"], r["direction"], r["connection"], bytes(r["raw"])) for r in spark.read.format("frame_log").load(log).collect())


def test_round_trip_rotation_and_append(spark, log):
    put(spark, log, rows(0, 2500))
    assert get(spark, log) == rows(0, 2500)
    names = sorted(f for f in os.listdir(log) if f.endswith(".gz"))
    assert {n.split("-")[0] for n in names} == {f"{h:08d}" for h in (5, 6, 7)} and len(names) == 5  # hours, and tasks
    assert spark.read.format("frame_log").option("partBytes", 2000).load(log).rdd.getNumPartitions() > len(names)  # ranges of offsets
    assert spark.read.format("frame_log").option("partBytes", 1).load(log).distinct().count() == 2500
    put(spark, log, rows(2500, 10, start=9 * HOUR))
    assert get(spark, log) == rows(0, 2500) + rows(2500, 10, start=9 * HOUR)
    put(spark, log, rows(7, 5), mode="overwrite")
    assert get(spark, log) == rows(7, 5) and not [f for f in os.listdir(log) if f.startswith("_")]
    # An ordinary reader reads the same files.
    assert sorted(r["sequence"] for r in files.frames(spark, f"{log}/*.gz").collect()) == list(range(7, 12))


def test_rows_that_do_not_follow_leave_nothing(spark, log):
    put(spark, log, rows(0, 20))
    before = sorted(os.listdir(log))
    for bad in (rows(19, 5), rows(21, 5), rows(20, 3) + rows(24, 2), rows(20, 2) + rows(20, 2)):
        with pytest.raises(Exception, match="sequence"):
            put(spark, log, bad, parts=1)
        assert [f for f in sorted(os.listdir(log)) if not f.startswith("_")] == before
    assert get(spark, log) == rows(0, 20)


def test_damage(spark, log, tmp_path):
    put(spark, log, rows(0, 50), parts=1)
    name = next(f"{log}/{f}" for f in os.listdir(log) if f.endswith(".gz"))
    whole = open(name, "rb").read()
    os.remove(f"{name}.idx")
    assert get(spark, log) == rows(0, 50)  # without an index
    plain = gzip.decompress(whole)
    for raw, ok in ((plain, True), (plain[:-1], False), (plain[:10], False), (whole[:-20], False), (plain[:26] + b"\x01" + plain[27:], False)):
        open(name, "wb").write(raw)
        if ok:
            assert get(spark, log) == rows(0, 50)
        else:
            with pytest.raises(Exception, match="cut off|damaged|CRC|not a gzipped|Compressed"):
                get(spark, log)


def test_no_log_and_no_rows(spark, log):
    assert get(spark, log) == []
    put(spark, log, [])
    assert get(spark, log) == []


def test_stream_of_a_growing_log(spark, log):
    put(spark, log, rows(0, 30))
    stream = lambda: spark.readStream.format("frame_log").load(log)
    assert sorted(r["sequence"] for r in feeds.sunk(stream(), "append").collect()) == list(range(30))
    put(spark, log, rows(30, 5, start=8 * HOUR))
    assert sorted(r["sequence"] for r in feeds.sunk(stream(), "append").collect()) == list(range(35))
