"""Plans of what to ask a source for, and checks of what it gave; nothing here needs a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SourceError(ValueError):
    """A request or a table that breaks its source's contract."""


def _hour(text: str) -> datetime:
    return datetime.strptime(text, "%Y-%m-%dT%H").replace(tzinfo=timezone.utc)


def hour_path(template: str, hour: str, first: str, last: str) -> str:
    """The object of an hour (2026-01-31T05) within the hours first to last, both included."""
    if not _hour(first) <= _hour(hour) <= _hour(last):
        raise SourceError(f"hour {hour} is outside of {first} to {last}")
    return template.format(hour=hour)


def request_plan(spark: SparkSession, start_s: int, end_s: int, span_s: int) -> DataFrame:
    """(index, start_s, end_s): aligned spans over [start, end). The last one is a minute early, so that its
    inclusive end is never the exclusive end of the period."""
    if span_s <= 60 or end_s - start_s < span_s + 60:
        raise SourceError("the period is shorter than a request")
    aligned = max(0, -(-(end_s - span_s - start_s) // span_s))
    d = spark.range(aligned + 1).select(F.col("id").alias("index"))
    start = F.when(F.col("index") < aligned, start_s + F.col("index") * span_s).otherwise(F.lit(end_s - span_s - 60))
    return d.withColumn("start_s", start).withColumn("end_s", F.col("start_s") + span_s)


def unique_table(df: DataFrame, key: str, what: str, rows: int | None = None, digest: str | None = None) -> DataFrame:
    """df, after a check that key is there and unique, and optionally of its row count and its digest (the sum of
    the hashes of all rows, in hexadecimal, whatever their order)."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("u"), total.alias("h")).first()
    if r["n"] != r["u"]:
        raise SourceError(f"{what}: {r['n']} rows of {r['u']} keys")
    if rows is not None and rows != r["n"]:
        raise SourceError(f"{what}: {r['n']} rows, not {rows}")
    have = f"{int(r['h'] or 0) % (1 << 64):016x}"
    if digest is not None and digest != have:
        raise SourceError(f"{what}: digest {have}, not {digest}")
    return df


def offset_pages(fetch: Callable[[int, int], list], limit: int, most: int) -> Iterator[list]:
    """Pages of a listing by offset, until a page is short or offset `most` is passed."""
    for offset in range(0, most + 1, limit):
        page = fetch(offset, limit)
        if page:
            yield page
        if len(page) < limit:
            return
    raise SourceError(f"more rows than offset {most} reaches")
