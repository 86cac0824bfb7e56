"""Writers."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit


def write_csv(df: DataFrame, path: str) -> None:
    """Flat rows as CSV with a header; nested columns go as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_decisions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_hours(df: DataFrame, path: str, time: str = "market_start_s") -> None:
    """Checkpoint by hour: rerunning some hours replaces these alone."""
    d = df.withColumn("hour", F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd'T'HH"))
    d.repartition("hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("hour").parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Idempotent append: rows whose keys the table lacks. Returns how many were written."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    new = audit.upsert(spark.read.parquet(path) if there else None, df, keys)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def archive_bodies(df: DataFrame, path: str, body: str = "body") -> None:
    """Bodies by content: each distinct one once, under its SHA-256, over all calls."""
    new = df.withColumn("sha256", F.sha2(F.col(body).cast("binary"), 256)).dropDuplicates(["sha256"])
    if _exists(df.sparkSession, path):
        new = new.join(df.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """The table at path with the rows of df in place of those of equal keys; of equal keys in df the row that is greatest in its other
    columns counts. The new table is written beside the old one, which then goes to `<path>.old`; for a moment no table has
    the name, and if the job ends there the next call takes the old one back first."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    if _exists(spark, old):
        if _exists(spark, path):
            files.delete(place(old), True)
        else:
            files.rename(place(old), place(path))
    there, others = _exists(spark, path), [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max(F.struct(*others)).alias("r")).select(*keys, "r.*") if others else df.distinct()
    if there:
        out = out.unionByName(spark.read.parquet(path).join(df.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    out.write.parquet(part)
    if there:
        files.rename(place(path), place(old))
    files.rename(place(part), place(path))
    files.delete(place(old), True)


def write_json(payload, path: str) -> None:
    """A small driver-side artifact, whole or not at all."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(payload, f, sort_keys=True, indent=1)
    os.replace(part, path)
