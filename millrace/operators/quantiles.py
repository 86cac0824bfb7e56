"""Exact quantiles of any number of rows: counts by value, narrowed to one bin before values are ordered.

Equal values are counted first, within each task and then by key. Each wanted rank is then found in ROUNDS rounds: the
distinct values of its bin are dealt into BINS finer ones, evenly between the bin's ends, and running counts over these (at most
BINS rows) give the bin that holds the rank. Only the values of the last bin are ordered. So no task and no
group holds a key's values, however many there are.

Defined results: nulls and NaN do not count; a key without values has no row; one value is every quantile; ties are counted
as often as they occur; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, ROUNDS = 1024, 2


def ranked_values(df: DataFrame, keys: list[str], value: str, wanted: list[tuple[str, float]]) -> DataFrame:
    """(keys, name, position, low, high): of each wanted (name, quantile) the place among a key's n values, 0 to n - 1, and the
    values at the whole places around it."""
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = counted.groupBy(*keys).agg(F.sum("n").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    names = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in wanted))
    places = ends.select(*keys, "all", "lo", "hi", F.explode(names).alias("w")).select(*keys, "lo", "hi", "w.name", ((F.col("all") - 1) * F.col("w.q")).alias("position"))
    both = F.array(F.floor("position").cast("long"), F.ceil("position").cast("long"))
    # One search for each distinct place of a key.
    ranks = places.select(*keys, "lo", "hi", F.explode(both).alias("rank")).distinct().withColumn("before", F.lit(0).cast("long"))
    for _ in range(ROUNDS):
        inner = counted.join(ranks, keys).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))) if keys else counted.crossJoin(F.broadcast(ranks)).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        width = F.col("hi") - F.col("lo")
        bin_of = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * BINS), F.lit(BINS - 1))).otherwise(0).cast("int")
        bins = inner.groupBy(*keys, "rank", "before", bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        ranks = bins.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*keys, "rank", "before", "lo", "hi")
    near = (counted.join(ranks, keys) if keys else counted.crossJoin(F.broadcast(ranks))).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    w = Window.partitionBy(*keys, "rank").orderBy("v")
    near = near.withColumn("upto", F.col("before") + F.sum("n").over(w))
    found = near.where(F.col("rank") < F.col("upto")).groupBy(*keys, "rank").agg(F.min("v").alias("v"))
    at = lambda f, name: found.select(*keys, F.col("rank").alias(f), F.col("v").alias(name))
    p = places.withColumns({"below": F.floor("position").cast("long"), "above": F.ceil("position").cast("long")})
    return p.join(at("below", "low"), [*keys, "below"]).join(at("above", "high"), [*keys, "above"]).select(*keys, "name", "position", "low", "high")


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(keys, a column for each name): linearly interpolated quantiles. wanted: name to (column, quantile)."""
    out = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for value in dict.fromkeys(c for c, _ in wanted.values()):
        names = [(n, q) for n, (c, q) in wanted.items() if c == value]
        r = ranked_values(df, keys, value, names)
        share = F.col("position") - F.floor("position")
        r = r.withColumn("x", F.col("low") + (F.col("high") - F.col("low")) * share)
        wide = r.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n, _ in names))
        out = out.join(wide, keys, "left") if keys else out.crossJoin(wide)  # one row
    return out


def value_at(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The quantiles of a column as numbers, a few of them, on the driver: thresholds of a grid."""
    names = {f"q{k}": (value, q) for k, q in enumerate(shares)}
    row = quantiles(df, [], names).first()
    if row is None or any(row[n] is None or math.isnan(row[n]) for n in names):
        raise ValueError(f"no values of {value}")
    return [row[n] for n in names]
