"""Readers of the file formats that collectors and archives leave. All schemas are given."""

from __future__ import annotations

import gzip
import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scalars as S

FRAME_HEAD = struct.Struct(">QQQBBHI")


def decision_ticks(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Per-second ticks, pruned to the schema; with ids, only their markets (a semi join)."""
    t = spark.read.schema(schemas.TICK).parquet(path)
    return t if ids is None else t.join(ids.select("condition_id"), "condition_id", "left_semi")


def universe(spark: SparkSession, path: str, assets: list[str], start_s: int, end_s: int, duration: str = "5m") -> DataFrame:
    """Markets within [start, end) of one duration; the predicates reach the Parquet scan, so later
    rows are never read."""
    u = spark.read.schema(schemas.UNIVERSE).parquet(path)
    u = u.where((F.col("market_start_ms") >= start_s * 1000) & (F.col("market_start_ms") < end_s * 1000) & (F.col("duration") == duration) & F.col("asset").isin(*assets))
    return u.withColumn("market_start_s", S.ceil_seconds("market_start_ms"))


def hourly_events(spark: SparkSession, root: str, first_hour: str, last_hour: str, ids: list[str] | None = None) -> DataFrame:
    """Book events of a table partitioned by hour (text, yyyy-MM-ddTHH): only the hours' files are
    listed. source_row is the row's place in its file."""
    e = spark.read.schema(schemas.BOOK_EVENT + ", hour string").parquet(root).where(F.col("hour").between(first_hour, last_hour))
    if ids:
        e = e.where(F.lower("condition_id").isin(*ids))
    return e.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))


def path_markets(spark: SparkSession, glob: str, pattern: str = r"([^/]+)_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.parquet$") -> DataFrame:
    """Rows of many Parquet files with the market's id and start, which only the file names have."""
    d = spark.read.parquet(glob).withColumn("file", F.col("_metadata.file_path"))
    start = F.unix_timestamp(F.regexp_extract("file", pattern, 2), "yyyy-MM-dd_HH-mm-ss")
    return d.withColumns({"condition_id": F.regexp_extract("file", pattern, 1), "market_start_s": start}).drop("file")


def coverage(hours: DataFrame, first_s: int, last_s: int, least: float = 0.99) -> float:
    """Share of the hours within [first, last) that a checkpoint table has; ValueError below least."""
    want = max(1, (last_s - first_s) // 3600)
    share = hours.where((F.col("hour_s") >= first_s) & (F.col("hour_s") < last_s)).select("hour_s").distinct().count() / want
    if share < least:
        raise ValueError(f"the table covers {share:.4f} of the hours, {least} are needed")
    return share


def _rows_of(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """A row of schema for each tuple that parse gives of a file's bytes; files are read by the
    executors, whatever store they are in."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = list(parse(raw))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, (*r, name), strict=True)) for r in rows], schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def _kline_rows(raw: bytes):
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        for name in sorted(z.namelist()):
            for line in io.TextIOWrapper(z.open(name), "utf-8"):
                cells = line.strip().split(",")
                if len(cells) == 12 and cells[0].isdigit():
                    yield (int(cells[0]), *map(float, cells[1:6]), int(cells[6]), float(cells[7]), int(cells[8]), float(cells[9]), float(cells[10]), cells[11])


def klines(spark: SparkSession, path: str, start_s: int, end_s: int, step: int = 60) -> DataFrame:
    """Minute bars from zipped CSV files; a zip cannot be split, so a task reads a file. Times come in
    micro- or milliseconds. ValueError at a gap or a price that is not positive."""
    d = _rows_of(spark, path, _kline_rows, schemas.KLINE + ", file string").withColumn("t", S.epoch_seconds("open_time")).where((F.col("t") >= start_s) & (F.col("t") < end_s))
    w = Window.partitionBy(F.floor(F.col("t") / 86_400)).orderBy("t")
    bad = d.agg(F.count_if(F.least("open", "high", "low", "close") <= 0), F.count(F.lit(1)), F.count_distinct("t"), F.min("t"), F.max("t")).first()
    if bad[0] or (bad[1] and (bad[1] != bad[2] or bad[4] - bad[3] != (bad[1] - 1) * step)) or d.withColumn("gap", F.col("t") - F.lag("t").over(w)).where(F.col("gap") != step).take(1):
        raise ValueError("bars have gaps, repeats or prices that are not positive")
    return d.select("t", "open", "high", "low", "close", "volume")


def minute_series(spark: SparkSession, path: str, tolerance: float = 1e-9) -> DataFrame:
    """(t, value) from JSON files of overlapping arrays of {t, v}; the overlaps must agree."""
    d = spark.read.schema("data array<struct<t:bigint,v:double>>").option("multiLine", True).json(path).select(F.explode("data").alias("p")).select("p.*")
    s = d.groupBy("t").agg(F.min("v").alias("value"), (F.max("v") - F.min("v")).alias("spread"))
    if s.where(F.col("spread") > tolerance).take(1):
        raise ValueError("overlapping responses disagree")
    return s.select("t", "value")


def _frame_rows(raw: bytes):
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(data):
        if at + FRAME_HEAD.size > len(data):
            raise ValueError("the frame log is cut off")
        seq, wall, mono, direction, connection, reserved, size = FRAME_HEAD.unpack_from(data, at)
        at += FRAME_HEAD.size
        if reserved or at + size > len(data):
            raise ValueError("the frame log is cut off or damaged")
        yield seq, wall, mono, "in" if direction == 0 else "out", connection, data[at : at + size]
        at += size


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Rows of binary frame logs (big-endian heads, gzip or plain); nanoseconds stay integers."""
    return _rows_of(spark, path, _frame_rows, schemas.FRAME + ", file string")


def frame_bytes(rows: list[tuple]) -> bytes:
    """The log of (sequence, wall_ns, monotonic_ns, direction, connection, raw) rows, compressed."""
    return gzip.compress(b"".join(FRAME_HEAD.pack(s, w, m, 0 if d == "in" else 1, c, 0, len(raw)) + raw for s, w, m, d, c, raw in rows), 1, mtime=0)


def sequence_breaks(frame_rows: DataFrame) -> DataFrame:
    """Frames whose sequence does not follow the one before, per file."""
    w = Window.partitionBy("file").orderBy("sequence")
    return frame_rows.withColumn("last", F.lag("sequence").over(w)).where(F.col("sequence") != F.col("last") + 1)


def sqlite_rows(spark: SparkSession, path: str, table: str, columns: list[str], schema: str) -> DataFrame:
    """Rows of a table of SQLite files; a task reads a file in batches."""

    def parse(raw: bytes):
        c = sqlite3.connect(":memory:")
        c.deserialize(raw)
        yield from c.execute(f"SELECT {', '.join(columns)} FROM {table}")

    return _rows_of(spark, path, parse, schema + ", file string")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Files of a manifest (name, bytes, sha256) that are missing or differ, and files that it lacks."""
    have = inventory(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("sha256").alias("actual"))
    j = manifest.join(have, "name", "full_outer")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("sha256").isNull(), "undeclared").when((F.col("bytes") != F.col("length")) | (F.col("sha256") != F.col("actual")), "differs")
    return j.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Market or page records of JSON lines; a line that does not fit fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_json(payload) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"))
