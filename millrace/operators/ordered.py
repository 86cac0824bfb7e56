"""Measures that depend on order, over groups of any size: rows are ordered within days only, and what days pass on (totals, last
values, counts) is carried over a table of a row a day.

Defined results: equal times are in order of the tie column; nulls in time or tie are not allowed; a group without rows has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics

DAY = 86_400


def rolling_day(df: DataFrame, value: str, time: str, tie: str, by: list[str], seconds: int = DAY) -> DataFrame:
    """Adds rolling: the sum over [time - seconds, the row itself]. Each row also stands in the next bucket of that many
    seconds, so a bucket and the one before it are all that a row needs."""
    own = F.floor(F.col(time) / seconds).cast("long")
    d = df.withColumn("__own", own).withColumn("__b", F.explode(F.array("__own", F.col("__own") + 1)))
    d = metrics.rolling_time_sum(d, value, time, tie, seconds, [*by, "__b"])
    return d.where(F.col("__b") == F.col("__own")).drop("__b", "__own")


def previous(df: DataFrame, value: str, time: str, tie: str, by: list[str], name: str) -> DataFrame:
    """Adds the value of the row before, NULL at the first."""
    d = df.withColumn("__b", F.floor(F.col(time) / DAY).cast("long"))
    inner = F.lag(value).over(Window.partitionBy(*by, "__b").orderBy(time, tie))
    first = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(time, tie)) == 1
    last = d.groupBy(*by, "__b").agg(F.max_by(value, F.struct(time, tie)).alias("__last"))
    last = last.select(*by, "__b", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b")).alias("__before"))
    d = d.withColumns({"__in": inner, "__first": first}).join(last, [*by, "__b"])
    return d.withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__in"))).drop("__b", "__in", "__first", "__before")


def longest_streak(df: DataFrame, value: str, time: str, tie: str, by: list[str]) -> DataFrame:
    """(by, longest) run of equal values: running counts of changes number the runs."""
    d = previous(df, value, time, tie, by, "__prev").withColumn("__new", F.when(F.col(value).eqNullSafe(F.col("__prev")), 0).otherwise(1))
    runs = metrics.running(d, "__new", time, tie, by).groupBy(*by, "cum").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*by).agg(F.max("n").alias("longest"))


def concentration(df: DataFrame, flag: str, time: str, tie: str, n: int, by: list[str]) -> DataFrame:
    """(by, concentration): the largest share of one side in n rows in a row, over all rows where fewer. Shares are differences of
    running counts n places apart."""
    d = df.select(*by, time, tie, F.col(flag).cast("double").alias("__f"), F.lit(1).alias("__1"))
    c = metrics.running(d, "__f", time, tie, by).select(*by, time, tie, "__1", "__f", F.col("cum").alias("__ups"))
    c = metrics.running(c, "__1", time, tie, by).select(*by, "__f", "__ups", F.col("cum").cast("long").alias("__i"))
    back = c.select(*by, (F.col("__i") + n).alias("__i"), F.col("__ups").alias("__then"))
    j = c.join(back, [*by, "__i"], "left")
    mean = F.when(F.col("__i") >= n, (F.col("__ups") - F.coalesce("__then", F.lit(0.0))) / n)
    share = lambda x: F.greatest(x, 1 - x)
    return j.groupBy(*by).agg(F.coalesce(F.max(share(mean)), share(F.avg("__f"))).alias("concentration"))


def regime_table(evaluated: DataFrame, by: list[str], time: str = "market_start_s", tie: str = "condition_id") -> DataFrame:
    """All nineteen measures of each group in one table: forecast quality, money and order."""
    filled = evaluated.where("filled").withColumn("__up", F.col("side") == 0)
    base = metrics.regime_metrics(evaluated, by)
    cash = metrics.turnover(evaluated, by, time, tie).drop("fills", "net_pnl")
    worst = rolling_day(evaluated, "net_pnl", time, tie, by).groupBy(*by).agg(F.min("rolling").alias("worst_rolling_24h"))
    back = metrics.recovery(metrics.running(evaluated, "net_pnl", time, tie, by), time, tie, by).select(*by, "recovery_seconds")
    streak = longest_streak(filled, "__up", time, tie, by).withColumnRenamed("longest", "longest_streak")
    share = concentration(filled, "__up", time, tie, 20, by).withColumnRenamed("concentration", "rolling_20_share")
    out = base
    for d in (cash, worst, back, streak, share):
        out = out.join(d, by, "left")
    return out.na.fill(0, ["longest_streak"])


def with_sub_period(evaluated: DataFrame, by: list[str], fold: str, start: int, end: int, time: str = "market_start_s", tie: str = "condition_id") -> DataFrame:
    """The table, how many folds earned, and the same measures over [start, end) with the prefix `bad_`, NULL where a group has no
    rows in it."""
    folds = evaluated.groupBy(*by, fold).agg(F.sum("net_pnl").alias("__p")).groupBy(*by).agg(F.count_if(F.col("__p") > 0).alias("positive_folds"))
    part = regime_table(evaluated.where((F.col(time) >= start) & (F.col(time) < end)), by, time, tie)
    part = part.select(*by, *(F.col(c).alias(f"bad_{c}") for c in part.columns if c not in by))
    return regime_table(evaluated, by, time, tie).join(folds, by, "left").join(part, by, "left")

