"""Joins that markets need: exact in time, as of a cutoff, lagged, overlapping, ranged, overlaid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def exact_join(cutoffs: DataFrame, ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of (keys, name) cutoffs to ticks on equal keys, all cutoffs in one join; of equal ticks
    the least event_id counts, so no cutoff fans out."""
    one = ticks.groupBy(*keys).agg(F.min_by("value", "event_id").alias("value"))
    return cutoffs.join(one, keys, "left")


def explode_cutoffs(df: DataFrame, cutoffs: dict[str, Column], at: str) -> DataFrame:
    """A row per cutoff: (…, cutoff, at)."""
    return df.withColumn("c", F.explode(F.array(*(F.struct(F.lit(n).alias("cutoff"), e.cast("long").alias(at)) for n, e in cutoffs.items())))).select(*df.columns, "c.*")


def asof_agg(ticks: DataFrame, keys: list[str], order: list[str], payload: list[str], backward: dict[str, Column], forward: dict[str, Column] | None = None) -> DataFrame:
    """As-of values at many cutoffs in one pass, without a join: for each backward cutoff the payload
    of the last tick at or before it, for each forward one of the first at or after it. One struct
    carries the payload, so its parts come from one tick; order's first column is time."""
    t = ticks.where(F.col(payload[0]).isNotNull())
    s, o = F.struct(*payload), F.struct(*order)
    time = F.col(order[0])
    pick = [F.max_by(F.when(time <= c, s), F.when(time <= c, o)).alias(n) for n, c in backward.items()]
    pick += [F.min_by(F.when(time >= c, s), F.when(time >= c, o)).alias(n) for n, c in (forward or {}).items()]
    return t.groupBy(*keys).agg(*pick)


def asof_latest(cutoffs: DataFrame, ticks: DataFrame, keys: list[str], at: str, order: list[str], payload: list[str]) -> DataFrame:
    """For each (keys, at) row the payload of the last tick at or before it (inner)."""
    o, s = F.struct(*order), F.struct(*payload)
    j = cutoffs.join(ticks, keys).where(F.col(order[0]) <= F.col(at)).where(F.col(payload[0]).isNotNull())
    return j.groupBy(*cutoffs.columns).agg(F.max_by(s, o).alias("r")).select(*cutoffs.columns, "r.*")


def asof_cross(cutoffs: DataFrame, ticks: DataFrame, at: str, order: list[str], payload: list[str]) -> DataFrame:
    """As of a short list of cutoffs, over all ticks: no key, so the list (its size is its
    literal length) is broadcast and ticks are aggregated where they lie."""
    j = ticks.join(F.broadcast(cutoffs), F.col(order[0]) <= F.col(at))
    return j.groupBy(*cutoffs.columns).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("r"), F.count(F.lit(1)).alias("n_before")).select(*cutoffs.columns, "n_before", "r.*")


def overlay(df: DataFrame, labels: DataFrame, key: str, column: str) -> DataFrame:
    """Authoritative labels over df's own: the label where there is one; mismatch marks a change."""
    j = df.join(labels.select(key, F.col(column).alias("__label")), key, "left")
    changed = F.coalesce(F.col("__label") != F.col(column), F.lit(False))
    return j.withColumns({"mismatch": changed, "overlaid": F.col("__label").isNotNull(), column: F.coalesce("__label", column)}).drop("__label")


def lag_path(df: DataFrame, series: DataFrame, key: str, at: str, steps: int, step: int, lag: int = 0) -> DataFrame:
    """(key, steps rows of place and value): values of an exact-time series at at - lag - k * step;
    a missing point stays NULL, nearer ones are never taken."""
    p = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("place"), F.col(at).alias("__at"))
    p = p.withColumn("t", F.col("__at") - lag - (steps - 1 - F.col("place")) * step)
    return p.join(series, "t", "left").select(key, "place", "t", "value")


def path_features(path: DataFrame, key: str, steps: int) -> DataFrame:
    """Return over the path, over its last step, and root mean square step return; NULL unless whole."""
    a = path.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("p"), F.count("value").alias("n"))
    v = F.transform("p", lambda x: x["value"])
    r = F.zip_with(F.slice(v, 2, steps - 1), F.slice(v, 1, steps - 1), lambda b, c: F.log(b / c))
    whole = F.col("n") == steps
    mean = F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x) / (steps - 1)
    return a.select(key, F.when(whole, F.log(v[steps - 1] / v[0])).alias("return_path"), F.when(whole, F.log(v[steps - 1] / v[steps - 2])).alias("return_last"), F.when(whole, F.sqrt(mean)).alias("volatility"))


def daily_windows(spark, start: int, end: int, days: int) -> DataFrame:
    """(window_id, start, end): windows of `days` days that step by a day, both ends inclusive."""
    n = max(0, (end - days * DAY + 1 - start) // DAY + 1)
    return spark.range(n).select(F.col("id").alias("window_id"), (F.lit(start) + F.col("id") * DAY).alias("start"), (F.lit(start + days * DAY - 1) + F.col("id") * DAY).alias("end"))


def window_ids(first: Column, last: Column, start: int, end: int, days: int) -> Column:
    """Ids of the daily windows that [first, last] overlaps, as an array."""
    n = max(0, (end - days * DAY + 1 - start) // DAY + 1)
    lo = F.greatest(F.lit(0), F.ceil((first - (start + days * DAY - 1)) / DAY)).cast("long")
    hi = F.least(F.lit(n - 1), F.floor((last - start) / DAY)).cast("long")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def overlap_counts(entities: DataFrame, first: str, last: str, start: int, end: int, days: int, by: list[str]) -> DataFrame:
    """How many entities' [first, last] overlap each daily window: each counts once in the window
    it enters and is taken off after the window it leaves, so a long-lived entity costs two rows."""
    lo = F.greatest(F.lit(0), F.ceil((F.col(first) - (start + days * DAY - 1)) / DAY)).cast("long")
    n = max(0, (end - days * DAY + 1 - start) // DAY + 1)
    hi = F.least(F.lit(n - 1), F.floor((F.col(last) - start) / DAY)).cast("long")
    e = entities.select(*by, lo.alias("lo"), hi.alias("hi")).where("lo <= hi")
    steps = e.select(*by, F.explode(F.array(F.struct(F.col("lo").alias("window_id"), F.lit(1).alias("d")), F.struct((F.col("hi") + 1).alias("window_id"), F.lit(-1).alias("d")))).alias("s")).select(*by, "s.*")
    return _running(steps.groupBy(*by, "window_id").agg(F.sum("d").alias("d")), n, by, {"d": "n"})


def _running(steps: DataFrame, n: int, by: list[str], names: dict[str, str]) -> DataFrame:
    from pyspark.sql import Window

    spark = steps.sparkSession
    spine = steps.select(*by).distinct().crossJoin(F.broadcast(spark.range(n + 1).select(F.col("id").alias("window_id"))))  # windows: the days of the period
    w = Window.partitionBy(*by).orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    d = spine.join(steps, [*by, "window_id"], "left")
    return d.select(*by, "window_id", *(F.sum(F.coalesce(c, F.lit(0))).over(w).alias(a) for c, a in names.items())).where(F.col("window_id") < n)


def range_sums(points: DataFrame, at: str, values: list[str], start: int, end: int, days: int, by: list[str]) -> DataFrame:
    """Sums of values of points inside each daily window: summed by day first, then days to windows."""
    day = F.floor((F.col(at) - start) / DAY).cast("long")
    daily = points.where(F.col(at).between(start, end)).groupBy(*by, day.alias("day")).agg(*(F.sum(v).alias(v) for v in values))
    n = max(0, (end - days * DAY + 1 - start) // DAY + 1)
    ids = F.sequence(F.greatest(F.lit(0), F.col("day") - days + 1), F.least(F.lit(n - 1), F.col("day")))
    ok = F.greatest(F.lit(0), F.col("day") - days + 1) <= F.least(F.lit(n - 1), F.col("day"))
    return daily.where(ok).withColumn("window_id", F.explode(ids)).groupBy(*by, "window_id").agg(*(F.sum(v).alias(v) for v in values))


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer join of two sources: where each row stands (both, left, right) and if values agree."""
    l, r = a.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("__l")), b.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    j = l.join(r, keys, "full_outer")
    where = F.when(F.col("__l").isNull(), "right").when(F.col("__r").isNull(), "left").otherwise("both")
    diff = F.abs(F.col("left_value") - F.col("right_value"))
    return j.select(*keys, "left_value", "right_value", where.alias("present"), F.coalesce(diff <= tolerance, F.lit(False)).alias("agrees"))


def inventory_diff(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two lists has."""
    j = declared.select(key, F.lit(1).alias("__d")).join(actual.select(key, F.lit(1).alias("__a")), key, "full_outer")
    return j.where(F.col("__d").isNull() | F.col("__a").isNull()).select(key, F.when(F.col("__a").isNull(), "missing").otherwise("undeclared").alias("problem"))


def require_coverage(df: DataFrame, other: DataFrame, key: str, what: str) -> DataFrame:
    """df, after a check that every key of it is in other."""
    lost = df.join(other, key, "left_anti").select(key).take(3)
    if lost:
        raise ValueError(f"{what}: no row for {[r[0] for r in lost]}")
    return df


def nearest_exact_boundary(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Reference values at market boundaries keyed (topic, symbol, start_ms): an exact value beats an
    inexact one, of equal ones the first received stays; unmatched boundaries keep NULL."""
    j = boundaries.join(points.withColumnRenamed("timestamp_ms", "start_ms"), ["topic", "symbol", "start_ms"], "left")
    best = F.min_by(F.struct("value", "exact_value"), F.struct(F.col("exact_value").isNull(), "received_ms"))
    return j.groupBy("topic", "symbol", "start_ms").agg(best.alias("r")).select("topic", "symbol", "start_ms", "r.*")
