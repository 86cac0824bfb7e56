"""Event documents: typed rows, and a reason for each of the others."""

import json

import pytest
from millrace.sources import universe

SCOPE = universe.Scope(1_000_000, 10_000_000_000_000, 300)
ID = "0x" + "aB" * 32


def event(market=None, **change):
    m = {"id": 5, "slug": "m", "outcomes": ["Up", "Down"], "clobTokenIds": ["1", "2"], "outcomePrices": ["1", "0"], "conditionId": ID, "feesEnabled": False} | (market or {})
    e = {"id": "e1", "slug": "s", "startTime": "2024-01-01T00:00:00Z", "endDate": "2024-01-01T00:05:00Z", "markets": [m]} | change
    return json.dumps({k: v for k, v in e.items() if v is not ...})


CASES = [
    (event(), None),
    (event({"outcomes": '["Up", "Down"]', "clobTokenIds": '["1","2"]', "outcomePrices": '["0","1.0"]'}), None),
    (event(startTime=...), None),
    (event(startTime="", endDate="2024-01-01T01:05:00.250+01:00"), None),
    (event({"feesEnabled": True, "feeSchedule": {"rate": 0.07, "takerOnly": True}}), None),
    (None, "not JSON"), ("", "not JSON"), ("{", "not JSON"),
    (event(endDate=...), "end time is missing or has no zone"), (event(endDate="2024-01-01T00:05:00"), "end time is missing or has no zone"), (event(endDate="soonZ"), "end time is missing or has no zone"), ("[1]", "end time is missing or has no zone"),
    (event(startTime="2024-01-01 00:00"), "start time has no zone"), (event(startTime="1969-12-31T23:55:00Z", endDate="1970-01-01T00:00:00Z"), "outside the period"), (event(endDate="2024-01-01T00:06:00Z"), "unexpected duration"),
    (event(markets=[]), "not one market"), (event(markets=[{}, {}]), "not one market"), (event(markets=None), "not one market"),
    (event({"outcomes": ["Down", "Up"]}), "unexpected outcome mapping"), (event({"clobTokenIds": ["1"]}), "unexpected outcome mapping"), (event({"outcomes": None}), "unexpected outcome mapping"),
    (event({"outcomePrices": ["x", "0"]}), "prices are not numbers"), (event({"outcomePrices": None}), "prices are not numbers"), (event({"outcomePrices": ["0.5", "0.5"]}), "not settled"), (event({"outcomePrices": ["1", "0", "0"]}), "not settled"),
    (event({"feesEnabled": True}), "fees without a rate"), (event({"feesEnabled": True, "feeSchedule": {"rate": 0.07}}), "unsupported fee schedule"), (event({"feesEnabled": True, "feeSchedule": {"rate": 0.07, "exponent": 2, "takerOnly": True}}), "unsupported fee schedule"), (event({"feesEnabled": True, "feeSchedule": {"rate": -1, "takerOnly": True}}), "unsupported fee schedule"),
    (event({"conditionId": "0x1"}), "invalid condition id"), (event({"conditionId": None}), "invalid condition id"),
]


@pytest.fixture
def docs(spark):
    return lambda texts: spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc int, raw string, slug_of string").repartition(2)


def test_reasons(docs):
    got = {r["doc"]: r["reason"] for r in universe.parsed(docs([t for t, _ in CASES]), "raw", SCOPE).collect()}
    assert [got[k] for k in range(len(CASES))] == [reason for _, reason in CASES]


def test_typed_rows_and_rejects(docs):
    other = "0x" + "c" * 64
    rows, rejects = universe.markets(docs([event(), event(), event({"conditionId": other}), event({"conditionId": other, "clobTokenIds": ["8", "9"]}), "{", event({"conditionId": "0x" + "d" * 64, "feesEnabled": True, "feeSchedule": {"rate": "0.07", "takerOnly": True}, "outcomePrices": ["0", "1"]}, startTime=...)]), "raw", SCOPE)
    got = sorted(tuple(r) for r in rows.select("condition_id", "event_id", "market_id", "slug", "token_up", "token_down", "market_start_ms", "market_end_ms", "outcome_up", "fee_rate", "fees_enabled").collect())
    at = 1_704_067_200_000
    assert got == [(ID.lower(), "e1", "5", "m", "1", "2", at, at + 300_000, 1.0, 0.0, False), ("0x" + "d" * 64, "e1", "5", "m", "1", "2", at, at + 300_000, 0.0, 0.07, True)]
    assert sorted((r["doc"], r["slug_of"], r["reason"]) for r in rejects.collect()) == [(2, "clash", "conflicting records"), (3, "clash", "conflicting records"), (4, "clash", "not JSON")]


def test_markets_that_are_not_settled_yet(docs):
    rows, rejects = universe.markets(docs([event({"outcomePrices": None}), event({"outcomePrices": ["0.5", "0.5"], "conditionId": "0x" + "e" * 64})]), "raw", universe.Scope(0, 10**14, 300, settled=False))
    assert [r["outcome_up"] for r in rows.collect()] == [None, None] and rejects.count() == 0


def test_token_mapping(spark, docs):
    ids = ["0x" + c * 64 for c in "abcde"]
    rows, _ = universe.markets(docs([event({"conditionId": i, "id": k}) for k, i in enumerate(ids)]), "raw", SCOPE)
    a, b, c, d, _ = ids
    m = [(a.upper().replace("0X", "0x"), "1", "Up"), (a, "2", "Down"), (b, "2", "Up"), (b, "1", "Down"), (c, "1", "Up"), (d, "1", "Up"), (d, "2", "Down"), (d, "3", "Down")]
    good, bad = universe.mapped(rows, spark.createDataFrame(m, "condition_id string, token_id string, outcome string"))
    assert [r["condition_id"] for r in good.collect()] == [a]
    assert sorted(tuple(r) for r in bad.collect()) == sorted([(b, "tokens differ"), (c, "tokens differ"), (d, "tokens differ"), (ids[4], "no mapping")])


def test_no_documents(docs):
    rows, rejects = universe.markets(docs(["{"]).where("false"), "raw", SCOPE)
    assert rows.count() == rejects.count() == 0
