"""The whole-book replay as a stream: state by market, levels after each micro-batch."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = ("receive_ms", "source_ms", "source_row")
LEVELS = "condition_id long, token string, side string, tick long, size double"


class Market(StatefulProcessor):
    """Both books of a market. Rows of a micro-batch come in order of receive time and are taken one by one, so a task holds
    a market's levels and one group of changes; a batch holds whole milliseconds of a market, so that no group is cut in two."""

    def __init__(self, scale: int):
        self.scale = scale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "token string, side string, tick long", "size double")
        self.tokens = handle.getMapState("tokens", "token string", "started boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        books: dict[str, dict[tuple[str, int], float]] = {t[0]: {} for t in self.tokens.keys()}
        for (token, side, tick), (size,) in self.levels.iterator():
            books[token][side, tick] = size
        before = {(t, *k): s for t, b in books.items() for k, s in b.items()}
        group: list[Row] = []
        last = None
        for r in rows:
            at = tuple(r[c] for c in ORDER)
            if last is not None and at < last:
                raise ValueError(f"rows of market {key[0]} are not in order: {at} after {last}")
            last = at
            change = r["event_type"] == "price_change"
            if group and (not change or r["receive_ms"] != group[0]["receive_ms"]):
                self._change(books, group)
                group = []
            if change:
                group.append(r)
            elif r["event_type"] == "book":
                self._book(books, r)
        if group:
            self._change(books, group)
        now = {(t, *k): s for t, b in books.items() for k, s in b.items()}
        for k in before.keys() - now.keys():
            self.levels.removeKey(k)
        for k, s in now.items():
            if before.get(k) != s:
                self.levels.updateValue(k, (s,))
        for t in books:
            self.tokens.updateValue((t,), (True,))
            yield Row(condition_id=key[0], token=t, side=None, tick=None, size=None)  # a book there is, if an empty one
        for (t, side, tick), s in now.items():
            yield Row(condition_id=key[0], token=t, side=side, tick=tick, size=s)

    def _book(self, books: dict, r: Row) -> None:
        sides = {"BUY": r["bids"] or (), "SELL": r["asks"] or ()}
        keep = lambda b: {k: s for k, s in b.items() if s > 0}
        if r["token"] not in books and r["other_token"] is not None and r["other_token"] not in books:
            other = {"BUY": "SELL", "SELL": "BUY"}
            books[r["other_token"]] = keep({(other[s], self.scale - x["tick"]): x["size"] for s, ls in sides.items() for x in ls})
        books[r["token"]] = keep({(s, x["tick"]): x["size"] for s, ls in sides.items() for x in ls})

    @staticmethod
    def _change(books: dict, group: list[Row]) -> None:
        if not books:
            return  # before the market's first book
        seen: dict[tuple[str, str], list[Row]] = {}
        for r in group:
            seen.setdefault((r["token"], r["side"]), []).append(r)
        for (token, side), rs in seen.items():
            for r in rs:
                if r["size"] > 0:
                    books[token][side, r["tick"]] = r["size"]
                else:
                    books[token].pop((side, r["tick"]), None)
        for token in {t for t, _ in seen}:
            rs = [r for (t, _), x in seen.items() if t == token for r in x]
            for side, hint, better in (("BUY", "best_bid", int.__gt__), ("SELL", "best_ask", int.__lt__)):
                last = next((r[hint] for r in reversed(rs) if r[hint] is not None), None)
                if last is not None:
                    for k in [k for k in books[token] if k[0] == side and better(k[1], last)]:
                        del books[token][k]


def levels(rows: DataFrame, scale: int = 1000) -> DataFrame:
    """All levels of a market after each micro-batch in which it had rows, and a row with a null side for each of
    its tokens. rows: a stream as `operators.replay` takes."""
    known = rows.where("event_type IS NOT NULL AND receive_ms IS NOT NULL AND token IS NOT NULL")
    book = F.col("event_type") == "book"
    known = known.withColumns({c: F.when(book, F.col(c)) for c in ("bids", "asks")})  # no other row uses them
    # Spark sorts each micro-batch, on disk where it is large. Its check refuses any sort of a stream: it can't tell that this one is
    # within a batch. Order holds across batches as rows arrive, and the processor fails on rows that come out of order.
    known.sparkSession.conf.set("spark.sql.streaming.unsupportedOperationCheck", "false")
    known = known.repartition("condition_id").sortWithinPartitions("condition_id", *ORDER)
    return known.groupBy("condition_id").transformWithState(Market(scale), LEVELS, "Update", "None")
