"""Whole books of two-outcome markets at many cutoffs, from archived snapshots and changes, in one pass.

Rows: condition_id, token, other_token, event_type, receive_ms, source_ms, source_row; a `book` row has bids and asks as
arrays of (tick, size), a `price_change` row has side (BUY or SELL), tick, size, best_bid and best_ask (ticks or null).
A row counts by the time at which it was received.

The rules: a book replaces all levels of its token; the first book of a market starts the other outcome too, with the
complement of its levels, unless that has one already; changes before the market's first book are ignored. Changes that are
neighbours in order and were received at one time are one group: the last write of a level counts, and after the
writes the group's last hint of a side deletes all levels better than it.

A level at a cutoff is its last write since its token's last start, if the size is not 0 and no later hint
cut it off. That is computed as a scan over segments: time is cut at the cutoffs and every SEGMENT_MS. Within a segment a
window finds the limit that later hints of the segment set, and the last write of each level stays. Segments are merged
by their own limits (least or greatest: associative), so no task reads all events of a token, however hot.

Defined results: nulls in event_type, time or token leave a row out; equal levels in one book: the last in its array; repeated rows
change nothing; empty books leave no level; no rows give no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of a segment: its rows of one token and side are ordered in one task.
SEGMENT_MS = 3_600_000
#: Runs within one millisecond that an order number has room for.
RUNS = 1 << 20
LEVEL = ["condition_id", "token", "side"]
AT = ("source_ms", "source_row")


def ordered(rows: DataFrame) -> DataFrame:
    """Adds o, the order number of a row's run: changes of one run share it, any other row has its own."""
    r = rows.where("event_type IS NOT NULL AND receive_ms IS NOT NULL AND token IS NOT NULL")
    w = Window.partitionBy("condition_id", "receive_ms").orderBy("source_ms", "source_row", "event_type", "token").rowsBetween(Window.unboundedPreceding, 0)
    change = F.col("event_type") == "price_change"
    others = F.sum((~change).cast("long")).over(w)
    return r.withColumn("o", F.col("receive_ms") * RUNS + F.when(change, 2 * others).otherwise(2 * others - 1))


def firsts(rows: DataFrame) -> DataFrame:
    """(condition_id, first_o, first_token) of each market's first book. rows: with o."""
    b = rows.where("event_type = 'book'")
    return b.groupBy("condition_id").agg(F.min(F.struct("o", "token")).alias("f")).select("condition_id", F.col("f.o").alias("first_o"), F.col("f.token").alias("first_token"))


def _hints(rows: DataFrame) -> DataFrame:
    """(level columns, o, hint): the hint of each side that a run of changes leaves, the last one that is not null: by first place of
    a row's side in the run, then by place."""
    c = rows.where("event_type = 'price_change'")
    c = c.withColumn("seen", F.min(F.struct(*AT)).over(Window.partitionBy("condition_id", "token", "o", "side")))
    last = lambda h: F.max_by(h, F.when(F.col(h).isNotNull(), F.struct("seen", F.struct(*AT).alias("at"))))
    h = c.where("best_bid IS NOT NULL OR best_ask IS NOT NULL").groupBy("condition_id", "token", "o").agg(last("best_bid").alias("BUY"), last("best_ask").alias("SELL"), F.first("receive_ms").alias("receive_ms"))
    return h.select("condition_id", "token", "o", "receive_ms", F.explode(F.create_map(F.lit("BUY"), F.col("BUY"), F.lit("SELL"), F.col("SELL"))).alias("side", "hint")).where("hint IS NOT NULL")


def _writes(rows: DataFrame, scale: int) -> DataFrame:
    """(level columns, o, place, tick, size, starts): levels of books, of the complement that the first one starts, and of changes.
    A book also gives a row without a tick for each side, so that an empty one starts too. rows: with first_o, first_token."""
    item = lambda token, side, tick, size, place, starts: F.struct(token.alias("token"), F.lit(side).alias("side"), tick.alias("tick"), size.alias("size"), place.alias("place"), F.lit(starts).alias("starts"))
    none, null = F.lit(None).cast("long"), F.lit(None).cast("double")

    def book(token: Column, bids: Column, asks: Column, flip: bool) -> Column:
        tick = lambda l: F.lit(scale) - l["tick"] if flip else l["tick"]
        side = lambda name, levels: F.transform(F.coalesce(levels, F.array().cast("array<struct<tick:bigint,size:double>>")), lambda l, i: item(token, name, tick(l), l["size"], i.cast("long"), True))
        return F.concat(F.array(item(token, "BUY", none, null, F.lit(-1).cast("long"), True), item(token, "SELL", none, null, F.lit(-1).cast("long"), True)), side("BUY", bids), side("SELL", asks))

    own = book(F.col("token"), F.col("bids"), F.col("asks"), False)
    other = book(F.col("other_token"), F.col("asks"), F.col("bids"), True)
    first = (F.col("o") == F.col("first_o")) & (F.col("token") == F.col("first_token")) & F.col("other_token").isNotNull()
    change = F.struct(F.col("token").alias("token"), F.col("side").alias("side"), F.col("tick").alias("tick"), F.col("size").alias("size"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("starts"))
    items = F.when(F.col("event_type") == "price_change", F.array(change)).when(F.col("event_type") == "book", F.when(first, F.concat(own, other)).otherwise(own))
    return rows.select("condition_id", "receive_ms", "source_ms", "source_row", "o", F.explode(items).alias("i")).select("condition_id", "receive_ms", "o", F.struct("source_ms", "source_row", "i.place").alias("place"), "i.token", "i.side", "i.tick", "i.size", "i.starts")


def scan(items: DataFrame, keys: list[str], time: str, cutoffs: list[int], segment: int, bid: Column) -> DataFrame:
    """(cutoff, keys, tick, size) of the levels that stand at each of the ascending cutoffs. items: keys (a token and a side), the time and
    o, the order; a write has tick, size and place (its order among those of one o); a hint has hint and after = 1; a
    start of the side has starts."""
    k = len(cutoffs)
    times = F.array(*(F.lit(c).cast("long") for c in cutoffs))
    bucket = F.size(F.filter(times, lambda c: c < F.col(time)))
    both = items.withColumns({"bucket": bucket, "segment": F.floor(F.col(time) / segment).cast("long") * (k + 1) + bucket})
    tightest = lambda w=None: F.when(bid, F.min("hint").over(w) if w is not None else F.min("hint")).otherwise(F.max("hint").over(w) if w is not None else F.max("hint"))
    later = Window.partitionBy(*keys, "segment").orderBy(F.desc("o"), F.desc("after")).rowsBetween(Window.unboundedPreceding, 0)
    local = both.withColumn("limit", tightest(later))
    kept = local.where("tick IS NOT NULL").groupBy(*keys, "tick", "segment", "bucket").agg(F.max_by(F.struct("size", "o", "limit"), F.struct("o", "place")).alias("w"))
    # What a segment does to the levels of earlier ones.
    parts = both.groupBy(*keys, "segment", "bucket").agg(F.min("hint").alias("low"), F.max("hint").alias("high"), F.max(F.when(F.col("starts"), F.col("o"))).alias("start"))
    parts = parts.withColumn("hint", F.when(bid, F.col("low")).otherwise(F.col("high"))).withColumn("k", F.explode(F.sequence(F.col("bucket"), F.lit(k - 1))))
    after = Window.partitionBy(*keys, "k").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "k")
    parts = parts.select(*keys, "segment", "k", tightest(after).alias("cut"), F.max("start").over(whole).alias("start"))
    # A segment's row of a level stands at the cutoffs from its own to the one before the level's next row.
    following = F.lead("bucket").over(Window.partitionBy(*keys, "tick").orderBy("segment"))
    stands = kept.withColumn("until", F.coalesce(following, F.lit(k)) - 1).where("until >= bucket").select(*keys, "tick", "segment", "w.*", F.explode(F.sequence(F.col("bucket"), F.col("until"))).alias("k"))
    met = stands.join(parts, [*keys, "segment", "k"]).where(F.col("o") >= F.col("start"))
    inside = lambda c: F.when(bid, F.col("tick") <= F.col(c)).otherwise(F.col("tick") >= F.col(c))
    alive = (F.col("size") > 0) & F.coalesce(inside("limit"), F.lit(True)) & F.coalesce(inside("cut"), F.lit(True))
    return met.where(alive).select(F.element_at(times, (F.col("k") + 1).cast("int")).alias("cutoff"), *keys, "tick", "size")


def depth_at(rows: DataFrame, cutoffs_ms: list[int], scale: int = 1000, segment_ms: int = SEGMENT_MS) -> DataFrame:
    """(cutoff, condition_id, token, side, tick, size) of all levels at each of the ascending cutoffs (a configured list)."""
    if not cutoffs_ms or any(b <= a for a, b in zip(cutoffs_ms, cutoffs_ms[1:], strict=False)):
        raise ValueError("cutoffs must ascend")
    r = ordered(rows.where(F.col("receive_ms") <= cutoffs_ms[-1]))
    r = r.join(firsts(r), "condition_id").where(F.col("o") >= F.col("first_o"))
    both = _writes(r, scale).select(*LEVEL, "receive_ms", "o", F.lit(0).alias("after"), "place", "tick", "size", "starts", F.lit(None).cast("long").alias("hint"))
    none = F.lit(None).cast(both.schema["place"].dataType)
    h = _hints(r).select(*LEVEL, "receive_ms", "o", F.lit(1).alias("after"), none.alias("place"), F.lit(None).cast("long").alias("tick"), F.lit(None).cast("double").alias("size"), F.lit(False).alias("starts"), "hint")
    both = both.unionByName(h)
    return scan(both, LEVEL, "receive_ms", cutoffs_ms, segment_ms, F.col("side") == "BUY")


def counts_at(rows: DataFrame, cutoffs_ms: list[int]) -> DataFrame:
    """(cutoff, condition_id, event_rows, ignored_rows, first_ms) of each market that has a book by the cutoff: rows received, changes
    before its first book, and when that came."""
    r = ordered(rows.where(F.col("receive_ms") <= cutoffs_ms[-1]))
    r = r.join(firsts(r), "condition_id")
    times = F.array(*(F.lit(c).cast("long") for c in cutoffs_ms))
    ignored = (F.col("event_type") == "price_change") & (F.col("o") < F.col("first_o"))
    bucket = F.size(F.filter(times, lambda c: c < F.col("receive_ms")))
    part = r.groupBy("condition_id", F.floor(F.col("first_o") / RUNS).cast("long").alias("first_ms"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(ignored).alias("i"))
    every = part.select("condition_id", "first_ms", "n", "i", F.explode(F.sequence(F.col("bucket"), F.lit(len(cutoffs_ms) - 1))).alias("k"))
    every = every.groupBy("condition_id", "first_ms", "k").agg(F.sum("n").alias("event_rows"), F.sum("i").alias("ignored_rows")).withColumn("cutoff", F.element_at(times, (F.col("k") + 1).cast("int")))
    return every.where("first_ms <= cutoff").select("cutoff", "condition_id", "event_rows", "ignored_rows", "first_ms")


def started(rows: DataFrame, cutoffs_ms: list[int]) -> DataFrame:
    """(cutoff, condition_id, token) of every token that has a book by the cutoff, empty ones too."""
    r = ordered(rows.where(F.col("receive_ms") <= cutoffs_ms[-1]))
    f = r.where("event_type = 'book'").groupBy("condition_id").agg(F.min_by(F.array("token", "other_token"), "o").alias("tokens"), F.min("receive_ms").alias("first_ms"))
    times = F.array(*(F.lit(c).cast("long") for c in cutoffs_ms))
    each = f.select("condition_id", "first_ms", F.explode("tokens").alias("token")).where("token IS NOT NULL")
    return each.select(F.explode(F.filter(times, lambda c: c >= F.col("first_ms"))).alias("cutoff"), "condition_id", "token")


def seventeen(c: str) -> Column:
    """A double with 17 significant digits, as C prints it: the JVM has no such form."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format(v, ".17g"), na_action="ignore")

    return text(c)


def digests(levels: DataFrame, tokens: DataFrame, by: list[str]) -> DataFrame:
    """(by, token, digest): SHA-256 of each token's book, a line a level, bids first, each side by rising tick, as
    side:tick:size. A token's levels are at most its ticks. tokens: (by, token), those without levels too."""
    rank = (F.col("side") == "SELL").cast("int")
    line = F.concat(F.when(F.col("side") == "BUY", "B:").otherwise("A:"), F.col("tick").cast("string"), F.lit(":"), seventeen("size"), F.lit("\n"))
    d = levels.select(*by, "token", F.struct(rank.alias("r"), F.col("tick").alias("t"), line.alias("line")).alias("l")).groupBy(*by, "token").agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(""))
    return tokens.select(*by, "token").distinct().join(d, [*by, "token"], "left").select(*by, "token", F.sha2(text.cast("binary"), 256).alias("digest"))


def tree_digest(per_token: DataFrame, by: list[str]) -> DataFrame:
    """(by, tokens, digest): one digest of all books in two levels, so no task reads every token. Tokens fall into 256
    groups by the first byte of their own SHA-256; a group's digest is that of its token:digest lines in order of
    tokens, the whole's is that of the group:digest lines in order of groups."""
    group = F.substring(F.sha2(F.col("token").cast("binary"), 256), 1, 2)

    def over(df: DataFrame, keys: list[str], name: str, count: Column) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct(name, "digest")))
        joined = F.array_join(F.transform(lines, lambda x: F.concat(x[name], F.lit(":"), x["digest"], F.lit("\n"))), "")
        return df.groupBy(*keys).agg(count.alias("tokens"), F.sha2(joined.cast("binary"), 256).alias("digest"))

    groups = over(per_token.withColumn("part", group), [*by, "part"], "token", F.count(F.lit(1)))
    return over(groups, by, "part", F.sum("tokens"))


def gaps(frames: DataFrame) -> DataFrame:
    """(sequence, expected) of the frames of a log that don't follow the one before. The first is 0. A frame's
    predecessor is looked up by its number, so no task orders the whole log."""
    s = frames.select("sequence").distinct()
    lost = s.join(s.select((F.col("sequence") + 1).alias("sequence")), "sequence", "left_anti").where("sequence <> 0")
    # The expected number is one more than the greatest below: found by blocks of numbers.
    size = 1 << 16
    top = s.groupBy(F.floor(F.col("sequence") / size).cast("long").alias("block")).agg(F.max("sequence").alias("top"))
    below = top.select("block", F.max("top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    at = lost.withColumn("block", F.floor(F.col("sequence") / size).cast("long"))
    near = at.join(s.select(F.col("sequence").alias("other"), F.floor(F.col("sequence") / size).cast("long").alias("block")), "block").where("other < sequence").groupBy("sequence").agg(F.max("other").alias("near"))
    return at.join(below, "block").join(near, "sequence", "left").select("sequence", (F.coalesce("near", "before", F.lit(-1)) + 1).alias("expected"))


def outcome(replayed: DataFrame, live: DataFrame, by: list[str]) -> DataFrame:
    """(by, status): match where a replay has the tokens and the digest that the live run had. Both: (by, tokens, digest)."""
    j = replayed.join(live.select(*by, F.col("tokens").alias("live_tokens"), F.col("digest").alias("live_digest")), by, "full_outer")
    same = F.col("tokens").eqNullSafe(F.col("live_tokens")) & F.col("digest").eqNullSafe(F.col("live_digest"))
    return j.select(*by, F.when(same, "match").otherwise("mismatch").alias("status"))
