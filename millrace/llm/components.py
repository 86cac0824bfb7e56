"""Connected components of an edge table, all in DataFrames: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import dropped, stored


def _least(e: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its v's. The minimum is pre-aggregated; a vertex of very many
    edges is split by the adaptive join."""
    m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(m, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of (a, b) edges, a stored table: the least id that it is linked to.

    Each round is stored, so a lost executor repeats one round; the table of the round before is deleted.
    Rounds grow with the logarithm of the longest path. Edges of a vertex with itself, or with a
    null end, link nothing and name no vertex; repeated edges count once; no edges give no rows."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct(), "edges")
        dropped(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    member = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id")).distinct().join(member.select("id"), "id", "left_anti")
    out = stored(member.unionByName(roots.select("id", F.col("id").alias("component"))), "components")
    dropped(e)
    return out
