"""Ordered measures over days against plain loops."""

import random

import pytest
from millrace.operators import ordered

DAY = 86_400


def rows(seed, n, days=9):
    r = random.Random(seed)
    return [(r.choice("ab"), k, r.choice([0, 1, DAY - 1, DAY, r.randrange(days * DAY)]), r.choice([True, True, False]), r.gauss(0, 1)) for k in range(n)]


@pytest.mark.parametrize(("seed", "n"), [(1, 300), (2, 25), (3, 8), (4, 1)])
def test_against_loops(spark, seed, n):
    data = rows(seed, n)
    df = spark.createDataFrame(data, "g string, id long, t long, up boolean, v double").repartition(3)
    streak = {r["g"]: r["longest"] for r in ordered.longest_streak(df, "up", "t", "id", ["g"]).collect()}
    share = {r["g"]: r["concentration"] for r in ordered.concentration(df, "up", "t", "id", 20, ["g"]).collect()}
    rolling = {r["id"]: r["rolling"] for r in ordered.rolling_day(df, "v", "t", "id", ["g"]).collect()}
    before = {r["id"]: r["p"] for r in ordered.previous(df, "v", "t", "id", ["g"], "p").collect()}
    assert len(rolling) == n
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (d[2], d[1]))
        best = run = 0
        for k, d in enumerate(own):
            run = run + 1 if k and own[k - 1][3] == d[3] else 1
            best = max(best, run)
            assert rolling[d[1]] == pytest.approx(sum(x[4] for x in own[: k + 1] if x[2] >= d[2] - DAY))
            assert before[d[1]] == (own[k - 1][4] if k else None)
        assert streak[g] == best
        ups = [float(d[3]) for d in own]
        means = [sum(ups[k - 20 : k]) / 20 for k in range(20, len(ups) + 1)] or [sum(ups) / len(ups)]
        assert share[g] == pytest.approx(max(max(m, 1 - m) for m in means))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, id long, t long, up boolean, v double")
    assert ordered.longest_streak(df, "up", "t", "id", ["g"]).count() == ordered.concentration(df, "up", "t", "id", 20, ["g"]).count() == ordered.rolling_day(df, "v", "t", "id", ["g"]).count() == 0


def test_recovery_takes_sums_that_differ_by_rounding_as_equal(spark):
    from millrace.operators import metrics

    gains = {1: (0.8, -0.8, 0.7, 0.1), 2: (-0.7, -0.1, 0.1, 0.7, -0.8)}  # 0.7 + 0.1 is 0.7999999999999999
    rows = [(u, 100 * i, i, g) for u, gs in gains.items() for i, g in enumerate(gs)]
    d = spark.createDataFrame(rows, "u long, t long, i long, g double")
    out = metrics.recovery(metrics.running(d, "g", "t", "i", ["u"], bucket=100), "t", "i", ["u"]).collect()
    assert {r["u"]: (round(r["max_drawdown"], 6), r["trough_t"], r["recovery_seconds"]) for r in out} == {1: (0.8, 100, 200), 2: (0.8, 100, 200)}
