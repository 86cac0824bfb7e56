"""Chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("train", "validation", "test")


def atomic(df: DataFrame, time: str, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """Adds split so that equal times never fall apart: the boundaries are the distinct times at
    floor(U * share). Distinct times are ordered, not rows; that list of times is joined back."""
    times = df.select(time).distinct()
    n = times.count()
    first, second = int(n * train), int(n * (train + validation))
    # Ranks of distinct times: within days, plus the number of times of the days before.
    t = times.withColumn("__d", F.floor(F.col(time) / 86_400))
    per = t.groupBy("__d").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    per = per.withColumn("__o", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__d").orderBy(time)) + F.col("__o")
    t = t.join(per, "__d").withColumn("__r", rank)
    name = F.when(F.col("__r") <= first, NAMES[0]).when(F.col("__r") <= second, NAMES[1]).otherwise(NAMES[2])
    return df.join(t.select(time, name.alias("split")), time)


def positional(df: DataFrame, order: list[str], train: float = 0.6, validation: float = 0.2, bucket: str = "market_start_s") -> DataFrame:
    """Adds split by row position floor(n * share) in order; positions are counted within days first."""
    n = df.count()
    d = df.withColumn("__d", F.floor(F.col(bucket) / 86_400))
    per = d.groupBy("__d").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)  # a row per day
    per = per.withColumn("__o", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    r = F.row_number().over(Window.partitionBy("__d").orderBy(*order)) + F.col("__o")
    first, second = int(n * train), int(n * train) + int(n * validation)
    return d.join(per, "__d").withColumn("split", F.when(r <= first, NAMES[0]).when(r <= second, NAMES[1]).otherwise(NAMES[2])).drop("__d", "__o")


def first_half(df: DataFrame, counted: DataFrame, by: list[str], order: list[str], bucket: str = "market_start_s") -> DataFrame:
    """Adds first_half: whether a row is among the first n // 2 of its group in order. counted: the same rows,
    of which only group and time are read. Rows are ordered within days; a table of days has the rest."""
    day = F.floor(F.col(bucket) / 86_400)
    per = counted.groupBy(*by, day.alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by)  # a row per day
    per = per.withColumns({"__o": F.coalesce(F.sum("__n").over(w.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__n").over(w)}).drop("__n")
    d = df.withColumn("__d", day)
    r = F.row_number().over(Window.partitionBy(*by, "__d").orderBy(*order)) + F.col("__o")
    return d.join(per, [*by, "__d"]).withColumn("first_half", r <= F.floor(F.col("__all") / 2)).drop("__d", "__o", "__all")


def folds(df: DataFrame, fold_rows: DataFrame, time: str, part: str = "validation") -> DataFrame:
    """Rows of each fold's half-open window; folds are a handful of configured rows."""
    f = F.broadcast(fold_rows.select("fold_id", F.col(f"{part}_start_s").alias("__s"), F.col(f"{part}_end_s").alias("__e")))
    return df.join(f, (F.col(time) >= F.col("__s")) & (F.col(time) < F.col("__e"))).drop("__s", "__e")
