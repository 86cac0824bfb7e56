"""Whole books at many cutoffs against a row-by-row replay."""

import hashlib
import random
import time

import pytest
from millrace.operators import replay
from pyspark.sql import functions as F

ROWS = "condition_id long, token string, other_token string, event_type string, receive_ms long, source_ms long, source_row long, bids array<struct<tick:bigint,size:double>>, asks array<struct<tick:bigint,size:double>>, side string, tick long, size double, best_bid long, best_ask long"
SCALE = 100


def direct(rows, cutoffs, scale=SCALE):
    """({(cutoff, condition, token, side, tick): size}, {(cutoff, condition): (rows, ignored, first)})."""
    levels, counts = {}, {}
    for condition in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == condition), key=lambda r: (r[4], r[5], r[6]))
        books, first, ignored, i = {}, None, 0, 0
        for cutoff in cutoffs:
            while i < len(own) and own[i][4] <= cutoff:
                r = own[i]
                if r[3] == "book":
                    books[r[1]] = {"BUY": dict(r[7] or ()), "SELL": dict(r[8] or ())}
                    if r[2] not in books:
                        flip = lambda x: {scale - t: s for t, s in x or ()}
                        books[r[2]] = {"BUY": flip(r[8]), "SELL": flip(r[7])}
                    first = r[4] if first is None else first
                    i += 1
                elif r[3] == "price_change":
                    group = []
                    while i < len(own) and own[i][3] == "price_change" and own[i][4] == r[4]:
                        group.append(own[i])
                        i += 1
                    if first is None:
                        ignored += len(group)
                        continue
                    by = {}
                    for g in group:
                        by.setdefault((g[1], g[9]), []).append(g)
                    for (token, side), gs in by.items():
                        books[token][side].update((g[10], g[11]) for g in gs)
                    for token in {t for t, _ in by}:
                        rows_of = [g for (t, _), gs in by.items() if t == token for g in gs]
                        bid = next((g[12] for g in reversed(rows_of) if g[12] is not None), None)
                        ask = next((g[13] for g in reversed(rows_of) if g[13] is not None), None)
                        if bid is not None:
                            books[token]["BUY"] = {t: s for t, s in books[token]["BUY"].items() if t <= bid}
                        if ask is not None:
                            books[token]["SELL"] = {t: s for t, s in books[token]["SELL"].items() if t >= ask}
                else:
                    i += 1
            if first is not None:
                counts[cutoff, condition] = i, ignored, first
                for token, sides in books.items():
                    levels |= {(cutoff, condition, token, side, t): s for side, x in sides.items() for t, s in x.items() if s > 0}
    return levels, counts


def feed(seed, n, conditions=3, span=400):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        c = r.randrange(conditions)
        token, other = r.sample([f"{c}up", f"{c}down"], 2)
        t = r.randrange(0, span)
        kind = r.choices(["price_change", "book", "last_trade_price"], [20, 1, 1])[0]
        side = lambda lo, hi: [(x, float(r.randint(0, 3))) for x in r.sample(range(lo, hi), r.randint(0, 6))]
        book = (side(20, 55), side(45, 80)) if kind == "book" else (None, None)
        change = (r.choice(["BUY", "SELL"]), r.randint(20, 80), float(r.choice([0, 0, 1, 2, 3])), r.choice([None, None, r.randint(30, 60)]), r.choice([None, None, r.randint(40, 70)])) if kind == "price_change" else (None,) * 5
        rows.append((c, token, other, kind, t, t - r.randrange(0, 3), k, *book, *change))
    return rows


@pytest.mark.parametrize(("seed", "segment"), [(1, 7), (2, 50), (3, 100_000), (4, 1), (5, 13)])
def test_books_at_cutoffs(spark, seed, segment):
    rows = feed(seed, 700)
    cutoffs = [15, 16, 120, 250, 399]
    levels, counts = direct(rows, cutoffs)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    got = {tuple(x)[:5]: x["size"] for x in replay.depth_at(df, cutoffs, SCALE, segment).collect()}
    assert got == levels and len(levels) > 40
    got = {(x["cutoff"], x["condition_id"]): (x["event_rows"], x["ignored_rows"], x["first_ms"]) for x in replay.counts_at(df, cutoffs).collect()}
    assert got == counts


def test_a_hot_token_is_spread_over_segments(spark):
    """All rows of one token: no task of the level windows holds more than a segment's."""
    rows = [(1, "a", "b", "book", 0, 0, 0, [(10, 1.0)], [(20, 1.0)], None, None, None, None, None)]
    rows += [(1, "a", "b", "price_change", 10 * k, 10 * k, k, None, None, "BUY", k % 9, float(k % 4), None, None) for k in range(1, 2000)]
    df = spark.createDataFrame(rows, ROWS)
    got = {tuple(x)[:5]: x["size"] for x in replay.depth_at(df, [5_000, 19_990], SCALE, 1_000).collect()}
    assert got == direct(rows, [5_000, 19_990])[0]


def test_cutoffs_must_ascend(spark):
    with pytest.raises(ValueError, match="ascend"):
        replay.depth_at(spark.createDataFrame([], ROWS), [5, 5])
    assert replay.depth_at(spark.createDataFrame([], ROWS), [5]).count() == 0


def digest_of(df, cutoffs):
    per = replay.digests(replay.depth_at(df, cutoffs, SCALE, 50), replay.started(df, cutoffs), ["cutoff"])
    return {r["cutoff"]: (r["tokens"], r["digest"]) for r in replay.tree_digest(per, ["cutoff"]).collect()}


def direct_digest(rows, cutoff):
    levels, counts = direct(rows, [cutoff])
    tokens = {t for r in rows if (cutoff, r[0]) in counts for t in (f"{r[0]}up", f"{r[0]}down")}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    parts = {}
    for t in sorted(tokens):
        own = sorted((side == "SELL", tick, size) for (_, _, token, side, tick), size in levels.items() if token == t)
        d = sha("".join(f"{'A' if s else 'B'}:{tick}:{size:.17g}\n" for s, tick, size in own))
        parts.setdefault(sha(t)[:2], []).append(f"{t}:{d}\n")
    return len(tokens), sha("".join(f"{p}:{sha(''.join(lines))}\n" for p, lines in sorted(parts.items())))


def test_one_digest_that_a_dropped_frame_changes(spark):
    rows = [(*r[:11], None if r[11] is None else r[11] / 3, *r[12:]) for r in feed(7, 400)]
    df = lambda rows: spark.createDataFrame(rows, ROWS).repartition(3)
    whole = digest_of(df(rows), [120, 399])
    assert whole == {c: direct_digest(rows, c) for c in (120, 399)}
    assert digest_of(df(rows[::-1]), [120, 399]) == whole  # order of files is of no meaning
    last = max((r for r in rows if r[3] == "book"), key=lambda r: (r[4], r[5], r[6]))
    assert digest_of(df([r for r in rows if r != last]), [399])[399] == direct_digest([r for r in rows if r != last], 399) != whole[399]


def test_stream_and_batch_give_one_digest(spark, tmp_path):
    from millrace.streaming import feeds, reference
    from millrace.streaming import replay as streams

    reference.stateful(spark)
    rows = sorted(feed(8, 400), key=lambda r: r[4])
    cuts = [0, *(next(k for k, r in enumerate(rows) if r[4] >= t) for t in (90, 91, 250)), len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(rows[a:b], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = feeds.sunk(streams.levels(stream, SCALE), "update")
    newest = out.groupBy("condition_id").agg(F.max("epoch").alias("epoch"))
    now = out.join(newest, ["condition_id", "epoch"]).withColumn("cutoff", F.lit(399).cast("long"))
    live = replay.tree_digest(replay.digests(now.where("side IS NOT NULL"), now.where("side IS NULL"), ["cutoff"]), ["cutoff"])
    assert {r["cutoff"]: (r["tokens"], r["digest"]) for r in live.collect()} == {399: direct_digest(rows, 399)}
    lost = spark.createDataFrame(rows[:-40], ROWS)
    again = replay.tree_digest(replay.digests(replay.depth_at(lost, [399], SCALE), replay.started(lost, [399]), ["cutoff"]), ["cutoff"])
    assert [r["status"] for r in replay.outcome(again, live, ["cutoff"]).collect()] == ["mismatch"]
    assert [r["status"] for r in replay.outcome(live, live, ["cutoff"]).collect()] == ["match"]


def test_gaps_of_a_log(spark):
    n = 1 << 16
    have = [0, 1, 2, 5, 6, n - 1, n, n + 3, 3 * n + 7, 3 * n + 8]
    df = spark.createDataFrame([(x,) for x in [*have, 5]], "sequence long")
    assert sorted(tuple(r) for r in replay.gaps(df).collect()) == [(5, 3), (n - 1, 7), (n + 3, n + 1), (3 * n + 7, n + 4)]
    assert [tuple(r) for r in replay.gaps(df.where("sequence > 4 AND sequence < 7")).collect()] == [(5, 0)]


class _Held(dict):
    """A map state in memory."""

    def iterator(self):
        return iter([(k, v) for k, v in self.items()])

    def updateValue(self, k, v):
        self[k] = v

    def removeKey(self, k):
        self.pop(k, None)


def test_a_stream_holds_one_group_of_changes_not_a_markets_rows():
    import weakref

    from millrace.streaming import replay as streams

    class R(dict):
        __hash__ = object.__hash__
        __eq__ = object.__eq__

    alive, most = weakref.WeakSet(), [0]
    names = [f.split()[0] for f in streams.LEVELS.split(", ")]

    def rows(times):
        for k, ms in enumerate(times):
            r = R(token="a", other_token="b", side="BUY", tick=k % 9, size=1.0, best_bid=None, best_ask=None, bids=[], asks=[], receive_ms=ms, source_ms=ms, source_row=k, event_type="price_change" if k else "book")
            alive.add(r)
            most[0] = max(most[0], len(alive))
            yield r

    def run(times):
        m = streams.Market(100)
        m.levels, m.tokens = _Held(), _Held()
        return [tuple(r[c] for c in names) for r in m.handleInputRows((1,), rows(times), None)]

    assert {r[3] for r in run([k // 5 for k in range(3000)])} == {None, *range(9)}
    assert most[0] < 20
    with pytest.raises(ValueError, match="not in order"):
        run([1, 3, 2])
