"""Order books from events, in batch.

`depth_at` is declarative: at a cutoff a level lives by its last write since the token's last snapshot,
if that is not 0 and no later hint cut it off. `fold` replays events one by one in order, per
token, for the best price as the feed keeps it (a hint to an empty level leaves no best price).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replay import scan

ORDER = ("t", "event_id")


def digest(levels: DataFrame, scale: int = 100) -> DataFrame:
    """SHA-256 of each token's book: a line per level, bids first, each side by rising price, as side:price
    index:size. levels: token, side, price, size (whole numbers)."""
    rank, at = (F.col("side") == "ask").cast("int"), F.round(F.col("price") * scale).cast("int")
    line = F.concat(F.when(F.col("side") == "bid", "B").otherwise("A"), F.lit(":"), at.cast("string"), F.lit(":"), F.col("size").cast("string"), F.lit("\n"))
    d = levels.groupBy("token").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), at.alias("i"), line.alias("line")))).alias("l"))
    return d.select("token", F.sha2(F.array_join(F.col("l.line"), "").cast("binary"), 256).alias("digest"), F.size("l").alias("levels"))


def token_state(events: DataFrame) -> DataFrame:
    """Per token the tick size in force and the outcome, once known: the last write of each in event order."""
    o = F.struct(*ORDER)
    last = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, o))
    return events.groupBy("token").agg(last("tick_size", "price").alias("tick_size"), last("resolved", "size").alias("winner"), F.count_if(F.col("kind") == "tick_size").alias("changes"))


def depth_at(events: DataFrame, *cutoffs: int, segment_us: int = 3_600_000_000) -> DataFrame:
    """(token, side, price, size) at a cutoff, with the cutoff at several. events: token, t (microseconds), event_id, kind (snapshot:
    one bid level; bid and ask: level writes; best_bid and best_ask: hints), price, size. Rows before a token's first snapshot do not
    count. One pass over segments of time, however many cutoffs and however hot a token (`replay.scan`)."""
    e = events.where((F.col("t") <= max(cutoffs)) & F.col("t").isNotNull() & F.col("kind").isNotNull())
    price, null = F.col("price"), F.lit(None).cast("double")
    item = lambda side, tick, size, hint, after, starts: F.struct(F.lit(side).alias("side"), tick.alias("tick"), size.alias("size"), hint.alias("hint"), F.lit(after).alias("after"), F.lit(starts).alias("starts"))
    no_size = F.lit(None).cast("long")
    write = lambda side: F.array(item(side, price, F.col("size"), null, 0, False))
    hint = lambda side: F.array(item(side, null, no_size, price, 1, False))
    start = F.array(item("bid", price, F.col("size"), null, 0, True), item("ask", null, no_size, null, 0, True))
    kind = F.col("kind")
    items = F.when(kind == "snapshot", start).when(kind == "bid", write("bid")).when(kind == "ask", write("ask")).when(kind == "best_bid", hint("bid")).when(kind == "best_ask", hint("ask"))
    i = e.select("token", "t", F.struct(*ORDER).alias("o"), F.lit(0).alias("place"), F.explode(items).alias("i")).select("token", "i.side", "t", "o", "place", "i.tick", "i.size", "i.hint", "i.after", "i.starts")
    d = scan(i, ["token", "side"], "t", sorted(cutoffs), segment_us, F.col("side") == "bid")
    return d.select(*(["cutoff"] if len(cutoffs) > 1 else []), "token", "side", F.col("tick").alias("price"), "size")


class Book:
    """State of one token: levels of each side and the best price of each, as the feed keeps them."""

    def __init__(self):
        self.levels: dict[str, dict[float, float]] = {"bid": {}, "ask": {}}
        self.best: dict[str, float | None] = {"bid": None, "ask": None}
        self.ready, self.ignored, self.crossed = False, 0, 0

    def apply(self, kind: str, price: float | None, size: float | None) -> None:
        if kind == "snapshot":
            self.levels = {"bid": {price: size} if size else {}, "ask": {}}
            self.best = {"bid": price if size else None, "ask": None}
            self.ready = True
        elif not self.ready:
            self.ignored += 1
        elif kind in self.levels:
            self._write(kind, price, size)
        else:
            self._hint(kind.removeprefix("best_"), price)
        a, b = self.best["ask"], self.best["bid"]
        self.crossed += a is not None and b is not None and b > a

    def _write(self, side: str, price: float, size: float) -> None:
        mine, best = self.levels[side], self.best[side]
        if size > 0:
            mine[price] = size
            if best is None or (price > best if side == "bid" else price < best):
                self.best[side] = price
        else:
            mine.pop(price, None)
            if price == best:
                self.best[side] = (max if side == "bid" else min)(mine, default=None)

    def _hint(self, side: str, price: float) -> None:
        mine = self.levels[side]
        for p in [p for p in mine if (p > price if side == "bid" else p < price)]:
            del mine[p]
        self.best[side] = price if price in mine else None

    def row(self) -> tuple:
        return self.best["bid"], self.best["ask"], len(self.levels["bid"]), len(self.levels["ask"]), self.ignored, self.crossed


def replay(rows: Iterable[tuple], book: Book | None = None) -> Book:
    """Folds (kind, price, size) rows that are in order."""
    book = book or Book()
    for kind, price, size in rows:
        book.apply(kind, price, size)
    return book


FOLDED = "token long, best_bid double, best_ask double, n_bids long, n_asks long, ignored long, crossed long"


def fold(events: DataFrame) -> DataFrame:
    """Exact replay of each token's events: one row per token. Events of a token are one stream by
    nature and are read in Arrow batches, in order; only the book itself is held."""
    ordered = events.select("token", *ORDER, "kind", "price", "size").repartition("token").sortWithinPartitions("token", *ORDER)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        token, book = None, None
        for f in frames:
            out = []
            for t, kind, price, size in zip(f["token"], f["kind"], f["price"], f["size"], strict=True):
                if t != token:
                    if book is not None:
                        out.append((token, *book.row()))
                    token, book = t, Book()
                book.apply(kind, price, size)
            if out:
                yield _frame(out)
        if book is not None:
            yield _frame([(token, *book.row())])

    return ordered.mapInPandas(run, FOLDED)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in FOLDED.split(", ")]).astype({"best_bid": float, "best_ask": float})
