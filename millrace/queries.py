"""Queries by name, over the sample tables, each with SQL that gives the same rows.

Doubles are rounded to six decimals at the end of both, since sums depend on order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import audit, book, execution, joins, metrics, models, search, splits
from .plans import backtest, grid_search
from .sources import views
from .streaming import feeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EDGES = S.uniform_edges(10)
R = backtest.RULES
DAY = 86_400
#: The ledger's period: January 2024, windows of a week.
START, END, DAYS = 1_704_067_200, 1_706_745_599, 7

# Pieces of SQL: each names the pieces that it builds on.
_E = "CAST(floor(epoch({})) AS BIGINT)"


def _bin(v: str) -> str:
    return f"CASE WHEN {v} IS NULL THEN 9 ELSE " + " + ".join(f"CAST({v} > {e!r} AS INT)" for e in EDGES[1:-1]) + " END"


def _eval(name: str, src: str, model: str, r, p: str = "probability_up", forced: str | None = None) -> str:
    """SQL of an evaluation of table src (decisions) against table model."""
    edge = lambda s, prob: f"{prob} - ask_{s} - {r.fee_rate!r} * (ask_{s} * (1 - ask_{s})) - {r.extra_cost!r}"
    side = forced or "CASE WHEN edge_down > edge_up THEN 1 ELSE 0 END"
    tie = "FALSE" if forced else "(edge_up = edge_down OR (isfinite(edge_up) AND isfinite(edge_down) AND abs(edge_up - edge_down) <= 1e-12))"
    low = "CAST('-infinity' AS DOUBLE)"
    cascade = "CASE WHEN NOT snapshot_valid THEN 1"
    if r.support_gate:
        cascade += f" WHEN support < {r.minimum_support} THEN 2"
    cascade += f" WHEN signal_ask < {r.minimum_ask!r} OR signal_ask > {r.maximum_ask!r} THEN 3"
    if r.persistence_gate:
        cascade += f" WHEN persistence < {r.minimum_persistence!r} THEN 4"
    if r.edge_gate and r.minimum_net_edge > float("-inf"):
        cascade += f" WHEN net_edge < {r.minimum_net_edge!r} THEN 5"
    cascade += " WHEN chosen_shares <= 0 THEN 6 WHEN tie THEN 7 ELSE 0 END"
    pick = lambda n: f"CASE WHEN side = 0 THEN {n}_up ELSE {n}_down END"
    return f"""
{name}_w0 AS (SELECT d.condition_id, d.side, d.price, d.size, coalesce(sum(d.price * d.size) OVER (PARTITION BY d.condition_id, d.side ORDER BY d.price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM depth d WHERE d.price > 0 AND d.price <= {r.maximum_ask!r} AND d.size > 0),
{name}_w1 AS (SELECT *, least(size, greatest({r.target!r} - before, 0) / price) AS taken FROM {name}_w0),
{name}_w2 AS (SELECT *, round_even(taken * ({r.fee_rate!r} * (price * (1 - price))) * 100000.0, 0) / 100000.0 AS fee FROM {name}_w1),
{name}_w AS (SELECT condition_id, sum(CASE WHEN side = 0 THEN taken ELSE 0 END) AS shares_up, sum(CASE WHEN side = 1 THEN taken ELSE 0 END) AS shares_down,
  sum(CASE WHEN side = 0 THEN taken * price ELSE 0 END) AS cost_up, sum(CASE WHEN side = 1 THEN taken * price ELSE 0 END) AS cost_down,
  sum(CASE WHEN side = 0 THEN fee ELSE 0 END) AS fee_up, sum(CASE WHEN side = 1 THEN fee ELSE 0 END) AS fee_down FROM {name}_w2 GROUP BY 1),
{name}_a AS (SELECT s.*, w.shares_up, w.shares_down, w.cost_up, w.cost_down, w.fee_up, w.fee_down, {_bin("s.mid_up")} AS bin FROM {src} s LEFT JOIN {name}_w w USING (condition_id)),
{name}_b AS (SELECT a.*, m.support, m.persistence, m.{p} AS p_up, 1 - m.{p} AS p_down FROM {name}_a a LEFT JOIN {model} m USING (bin)),
{name}_c AS (SELECT *, coalesce({edge("up", "p_up")}, {low}) AS edge_up, coalesce({edge("down", "p_down")}, {low}) AS edge_down FROM {name}_b),
{name}_d AS (SELECT *, {side} AS side, {tie} AS tie FROM {name}_c),
{name}_e AS (SELECT *, {pick("p")} AS probability, {pick("ask")} AS signal_ask, {pick("edge")} AS net_edge, coalesce({pick("shares")}, 0) AS chosen_shares, coalesce({pick("cost")}, 0) AS chosen_cost, coalesce({pick("fee")}, 0) AS chosen_fee FROM {name}_d),
{name}_f AS (SELECT *, {cascade} AS status FROM {name}_e),
{name}_g AS (SELECT *, status = 0 AS filled, CASE WHEN status = 0 THEN chosen_shares ELSE 0 END AS fill_shares, CASE WHEN status = 0 THEN chosen_cost ELSE 0 END AS fill_cost, CASE WHEN status = 0 THEN chosen_fee ELSE 0 END AS platform_fee,
  CASE WHEN chosen_shares <> 0 THEN chosen_cost / chosen_shares END AS fill_vwap FROM {name}_f),
{name}_h AS (SELECT *, fill_shares * {r.extra_cost!r} AS extra_cost, CASE WHEN filled THEN coalesce(fill_shares * (CASE WHEN side = 0 THEN outcome_up ELSE 1 - outcome_up END), 0) - fill_cost ELSE 0 END AS gross_pnl FROM {name}_g),
{name} AS (SELECT *, gross_pnl - platform_fee - extra_cost AS net_pnl FROM {name}_h)"""


def _model(name: str, src: str) -> str:
    """SQL of a lookup model over table src."""
    return f"""
{name}_r AS (SELECT {_bin("previous_mid_up")} AS prev_bin, {_bin("mid_up")} AS bin, outcome_up FROM {src} WHERE snapshot_valid AND outcome_up BETWEEN 0 AND 1),
{name} AS (SELECT b.bin, (coalesce(w.wins, 0) + 20.0 * p.prior) / (coalesce(w.support, 0) + 20.0) AS probability_up, coalesce(w.support, 0) AS support, (coalesce(s.n, 0) + 1.0) / (coalesce(l.n, 0) + 10.0) AS persistence
  FROM (SELECT CAST(range AS INT) AS bin FROM range(10)) b
  LEFT JOIN (SELECT bin, count(*) AS support, sum(outcome_up) AS wins FROM {name}_r GROUP BY 1) w USING (bin)
  LEFT JOIN (SELECT bin, count(*) AS n FROM {name}_r WHERE prev_bin = bin GROUP BY 1) s USING (bin)
  LEFT JOIN (SELECT prev_bin AS bin, count(*) AS n FROM {name}_r GROUP BY 1) l USING (bin)
  CROSS JOIN (SELECT avg(outcome_up) AS prior FROM {name}_r) p)"""


def _transition(name: str, src: str) -> str:
    """SQL of a transition matrix over (prev_bin, bin) rows."""
    return f"""
{name}_c AS (SELECT a.range AS prev_bin, b.range AS bin, coalesce(n, 0) AS n FROM range(10) a CROSS JOIN range(10) b LEFT JOIN (SELECT prev_bin, bin, count(*) AS n FROM {src} GROUP BY 1, 2) c ON c.prev_bin = a.range AND c.bin = b.range),
{name} AS (SELECT CAST(prev_bin AS INT) AS prev_bin, CAST(bin AS INT) AS bin, n, (n + 1.0) / sum(n + 1.0) OVER (PARTITION BY prev_bin) AS p FROM {name}_c)"""


_GRID = grid_search.GRID
_FOLD_SQL = ",".join(
    f"fd{f.fold_id} AS (SELECT * FROM decisions WHERE market_start_s >= {f.validation_start_s} AND market_start_s < {f.validation_end_s}), ft{f.fold_id} AS (SELECT * FROM decisions WHERE market_start_s >= {f.train_start_s} AND market_start_s < {f.train_end_s}),"
    + _model(f"fm{f.fold_id}", f"ft{f.fold_id}")
    + ","
    + _eval(f"fe{f.fold_id}", f"fd{f.fold_id}", f"fm{f.fold_id}", grid_search.OPEN)
    for f in grid_search.FOLDS
)

PIECES: dict[str, tuple[tuple[str, ...], str]] = {
    "market": ((), f"market AS (SELECT o_orderkey AS condition_id, o_orderpriority AS asset, {_E.format('o_orderdate')} AS market_start_s, CASE o_orderstatus WHEN 'F' THEN CAST(1 AS DOUBLE) WHEN 'O' THEN CAST(0 AS DOUBLE) END AS outcome_up FROM orders)"),
    "depth": ((), "depth AS (SELECT l_orderkey AS condition_id, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS side, CAST(greatest(floor(l_extendedprice / 1100), 1) AS DOUBLE) / 100 AS price, sum(l_quantity) AS size FROM lineitem GROUP BY 1, 2, 3)"),
    "top": (("depth",), """top0 AS (SELECT condition_id, min(price) FILTER (side = 0) AS ask_up, min(price) FILTER (side = 1) AS ask_down, max(price) FILTER (side = 0) AS previous_mid_up FROM depth GROUP BY 1),
top1 AS (SELECT *, CASE WHEN ask_up IS NOT NULL THEN greatest(ask_up - CAST(0.01 AS DOUBLE), 0) END AS bid_up, CASE WHEN ask_down IS NOT NULL THEN greatest(ask_down - CAST(0.01 AS DOUBLE), 0) END AS bid_down FROM top0),
top AS (SELECT *, (bid_up + ask_up) / 2 AS mid_up, (bid_down + ask_down) / 2 AS mid_down, ask_up IS NOT NULL AND ask_down IS NOT NULL AS snapshot_valid FROM top1)"""),
    "decisions": (("market", "top"), "decisions AS (SELECT m.*, t.* EXCLUDE (condition_id) FROM market m JOIN top t USING (condition_id))"),
    "split": (("decisions",), """times AS (SELECT market_start_s, row_number() OVER (ORDER BY market_start_s) AS r, count(*) OVER () AS u FROM (SELECT DISTINCT market_start_s FROM decisions)),
split AS (SELECT d.*, CASE WHEN r <= floor(u * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN r <= floor(u * (CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM decisions d JOIN times USING (market_start_s)),
train AS (SELECT * FROM split WHERE split = 'train'), test AS (SELECT * FROM split WHERE split = 'test')"""),
    "model": (("split",), _model("model", "train").strip()),
    "result": (("model",), _eval("result", "split", "model", R).strip()),
    "path": (("result",), """path0 AS (SELECT *, sum(net_pnl) OVER (PARTITION BY split ORDER BY market_start_s, condition_id) AS cum FROM result),
path AS (SELECT *, cum - net_pnl AS before, greatest(0, max(cum) OVER (PARTITION BY split ORDER BY market_start_s, condition_id)) AS peak, greatest(0, max(cum) OVER (PARTITION BY split ORDER BY market_start_s, condition_id)) - cum AS drawdown FROM path0)"""),
    "tick": ((), f"tick0 AS (SELECT event_id, user_id, {_E.format('ts')} AS t, event_type, value FROM events), tick AS (SELECT *, t - t % 86400 AS market_start_s FROM tick0)"),
    "activity": ((), f"""act0 AS (SELECT event_id, user_id, {_E.format('ts')} AS t, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
activity AS (SELECT event_id, user_id % 3 AS account_id, user_id * 10 + k % 10 AS condition_id, t, CASE event_type WHEN 'purchase' THEN 'TRADE' WHEN 'click' THEN 'SPLIT' WHEN 'view' THEN 'REDEEM' WHEN 'signup' THEN 'MERGE' ELSE 'REWARD' END AS activity_type,
  CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, value AS usdc_size, k / 100 AS price FROM act0),
cash AS (SELECT *, CASE WHEN activity_type = 'TRADE' AND side = 'BUY' THEN -usdc_size WHEN activity_type = 'TRADE' THEN usdc_size WHEN activity_type = 'SPLIT' THEN -usdc_size ELSE usdc_size END AS cash_flow, CASE WHEN activity_type = 'REWARD' THEN usdc_size ELSE 0 END AS reward_cash FROM activity)"""),
    "windows": (("activity",), f"windows AS (SELECT range AS window_id, {START} + range * 86400 AS s, {START + DAYS * DAY - 1} + range * 86400 AS e FROM range({(END - DAYS * DAY + 1 - START) // DAY + 1}))"),
    "settled": (("activity",), "settled AS (SELECT account_id, condition_id, max(t) AS close_t, sum(cash_flow) AS pnl FROM cash WHERE activity_type IN ('TRADE', 'SPLIT', 'REDEEM', 'MERGE') AND condition_id IS NOT NULL GROUP BY 1, 2 HAVING max(CASE WHEN activity_type IN ('REDEEM', 'MERGE') THEN 1 ELSE 0 END) = 1)"),
    "audit": (("windows", "settled"), """spans AS (SELECT account_id, condition_id, min(t) AS a, max(t) AS b FROM activity WHERE activity_type = 'TRADE' GROUP BY 1, 2),
accounts AS (SELECT DISTINCT account_id FROM activity),
audit AS (SELECT account_id, window_id, s AS start, e AS "end",
  coalesce((SELECT sum(cash_flow) FROM cash c WHERE c.account_id = a.account_id AND c.t BETWEEN s AND e), 0) AS cash_flow,
  coalesce((SELECT sum(reward_cash) FROM cash c WHERE c.account_id = a.account_id AND c.t BETWEEN s AND e), 0) AS reward_cash,
  (SELECT count(*) FROM cash c WHERE c.account_id = a.account_id AND c.t BETWEEN s AND e AND activity_type = 'TRADE') AS trades,
  coalesce((SELECT sum(pnl) FROM settled c WHERE c.account_id = a.account_id AND close_t BETWEEN s AND e), 0) AS pnl,
  (SELECT count(*) FROM settled c WHERE c.account_id = a.account_id AND close_t BETWEEN s AND e) AS resolved,
  coalesce((SELECT max(pnl) FROM settled c WHERE c.account_id = a.account_id AND close_t BETWEEN s AND e), 0) AS biggest_win,
  (SELECT count(*) FROM spans c WHERE c.account_id = a.account_id AND c.a <= w.e AND c.b >= w.s) AS unique_markets
  FROM accounts a CROSS JOIN windows w)"""),
    "book": ((), """book AS (SELECT event_id, user_id AS token, CAST(epoch_us(ts) AS BIGINT) AS t, CASE event_type WHEN 'signup' THEN 'snapshot' WHEN 'purchase' THEN 'bid' WHEN 'click' THEN 'ask' WHEN 'view' THEN 'best_bid' ELSE 'best_ask' END AS kind,
  CAST(json_extract_string(props, '$.k') AS BIGINT) / 100 AS price, CAST(floor(value) AS BIGINT) % 5 AS size FROM events)"""),
    "folds": (("decisions",), _FOLD_SQL + ", folds0 AS (" + " UNION ALL BY NAME ".join(f"SELECT *, {f.fold_id} AS fold_id FROM fe{f.fold_id}" for f in grid_search.FOLDS) + """),
folds AS (SELECT *, CASE WHEN filled THEN net_pnl - CAST(0.01 AS DOUBLE) * fill_shares ELSE 0 END AS stress_pnl, row_number() OVER (PARTITION BY fold_id ORDER BY market_start_s, condition_id) <= floor(count(*) OVER (PARTITION BY fold_id) / 2) AS first_half FROM folds0)"""),
    "cells": ((), "cells AS (SELECT CAST(((a.i * {n1} + b.i) * {n2} + c.i) * {n3} + d.i AS INT) AS cell_id, CAST(a.i AS INT) AS i0, CAST(b.i AS INT) AS i1, CAST(c.i AS INT) AS i2, CAST(d.i AS INT) AS i3, a.v AS minimum_ask, b.v AS maximum_ask, c.v AS minimum_persistence, d.v AS minimum_edge FROM {a} a, {b} b, {c} c, {d} d WHERE a.v < b.v)".format(
        n1=len(_GRID.maximum_ask), n2=len(_GRID.minimum_persistence), n3=len(_GRID.minimum_edge),
        **{k: "(SELECT unnest([" + ",".join(f"CAST({x!r} AS DOUBLE)" for x in v) + "]) AS v, unnest(range(" + str(len(v)) + ")) AS i)" for k, v in zip("abcd", _GRID.axes(), strict=True)},
    )),
    "grid": (("folds", "cells"), """grid AS (SELECT f.fold_id, c.*, coalesce(count(*) FILTER (ok), 0) AS fills, coalesce(sum(net_pnl) FILTER (ok), 0) AS net_pnl, coalesce(sum(greatest(net_pnl, 0)) FILTER (ok), 0) AS gross_profit, coalesce(sum(greatest(-net_pnl, 0)) FILTER (ok), 0) AS gross_loss,
  coalesce(sum(stress_pnl) FILTER (ok), 0) AS stress_pnl, coalesce(sum(net_pnl) FILTER (ok AND first_half), 0) AS half1_pnl, coalesce(sum(net_pnl) FILTER (ok AND NOT first_half), 0) AS half2_pnl
  FROM cells c CROSS JOIN (SELECT DISTINCT fold_id FROM folds) f LEFT JOIN LATERAL (SELECT net_pnl, stress_pnl, first_half, signal_ask >= c.minimum_ask AND signal_ask <= c.maximum_ask AND fill_vwap <= c.maximum_ask AND persistence >= c.minimum_persistence AND net_edge >= c.minimum_edge AS ok FROM folds x WHERE x.fold_id = f.fold_id AND x.filled) z ON TRUE GROUP BY ALL)"""),
    "pool": (("grid",), """pool0 AS (SELECT cell_id, i0, i1, i2, i3, minimum_ask, maximum_ask, minimum_persistence, minimum_edge, sum(fills) AS fills, sum(net_pnl) AS net_pnl, sum(gross_profit) AS gross_profit, sum(gross_loss) AS gross_loss, sum(stress_pnl) AS stress_pnl,
  count(*) FILTER (net_pnl > 0) AS positive_folds, count(*) FILTER (stress_pnl > 0) AS positive_stress_folds, count(*) AS folds FROM grid GROUP BY ALL),
pool AS (SELECT *, CASE WHEN gross_loss > 0 THEN gross_profit / gross_loss WHEN gross_profit > 0 THEN CAST('infinity' AS DOUBLE) ELSE 0 END AS profit_factor FROM pool0)"""),
    "floor": (("pool",), """near AS (SELECT p.cell_id AS c, q.*, abs(p.i0 - q.i0) + abs(p.i1 - q.i1) + abs(p.i2 - q.i2) + abs(p.i3 - q.i3) AS away FROM pool p JOIN pool q ON abs(p.i0 - q.i0) + abs(p.i1 - q.i1) + abs(p.i2 - q.i2) + abs(p.i3 - q.i3) <= 1),
floors AS (SELECT p.*, coalesce(f.a, CAST('infinity' AS DOUBLE)) AS floor_pnl, coalesce(f.b, p.folds) AS floor_folds FROM pool p LEFT JOIN (SELECT c, min(net_pnl) AS a, min(positive_folds) AS b FROM near WHERE away = 1 GROUP BY 1) f ON f.c = p.cell_id)"""),
    "plateau": (("floor",), """plateau AS (SELECT p.*, g.* EXCLUDE (c) FROM floors p JOIN (SELECT c, count(*) AS members, median(net_pnl) AS median_pnl, median(stress_pnl) AS median_stress_pnl, median(positive_folds) AS median_positive_folds, avg(CAST(net_pnl > 0 AS INT)) AS profitable_fraction,
  avg(CAST(stress_pnl > 0 AS INT)) AS stress_profitable_fraction, min(net_pnl) AS minimum_pnl, max(net_pnl) AS maximum_pnl FROM near GROUP BY 1) g ON g.c = p.cell_id)"""),
    "gated": (("plateau",), """gated0 AS (SELECT *, fills >= 30 AS g1, net_pnl > 0 AS g2, profit_factor > 1 AS g3, stress_pnl > 0 AS g4, positive_folds >= 2 AS g5, median_pnl > 0 AS g6, profitable_fraction >= CAST(0.6 AS DOUBLE) AS g7, floor_folds >= 1 AS g8 FROM plateau),
gated AS (SELECT *, CAST(g1 AS INT) + CAST(g2 AS INT) + CAST(g3 AS INT) + CAST(g4 AS INT) + CAST(g5 AS INT) + CAST(g6 AS INT) + CAST(g7 AS INT) + CAST(g8 AS INT) AS passed FROM gated0)"""),
}


def sql(select: str, *uses: str, doubles: str = "") -> str:
    """A statement over the pieces that it uses; doubles: columns to round."""
    order: list[str] = []

    def visit(name: str) -> None:
        for x in PIECES[name][0]:
            visit(x)
        if name not in order:
            order.append(name)

    for u in uses:
        visit(u)
    rounded = f"* REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in doubles.split())})" if doubles else "*"
    return "WITH " + ",\n".join([PIECES[n][1] for n in order] + [f"out AS ({select})"]) + f"\nSELECT {rounded} FROM out"


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- scans -------------------------------------------------------------------------------------


@query("q_market_scan_filter", sql("SELECT * FROM market WHERE asset IN ('1-URGENT', '2-HIGH') AND outcome_up IS NOT NULL AND market_start_s >= 820454400 AND market_start_s < 852076800 ORDER BY market_start_s, condition_id LIMIT 500", "market"))
def market_scan(spark, sf_dir):
    m = views.markets(spark, sf_dir).where(F.col("asset").isin("1-URGENT", "2-HIGH") & F.col("outcome_up").isNotNull() & (F.col("market_start_s") >= 820454400) & (F.col("market_start_s") < 852076800))
    return m.orderBy("market_start_s", "condition_id").limit(500)  # the operator is a top-k report


@query("q_tick_scan_isin", sql("SELECT user_id, count(*) AS n, sum(value) AS total FROM tick WHERE user_id IN (3, 7, 11) AND event_type IN ('view', 'click') GROUP BY 1", "tick", doubles="total"))
def tick_scan(spark, sf_dir):
    t = views.ticks(spark, sf_dir).where(F.col("user_id").isin(3, 7, 11) & F.col("event_type").isin("view", "click"))
    return t.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- joins -------------------------------------------------------------------------------------

_KEYED = "keyed AS (SELECT DISTINCT user_id, market_start_s FROM tick)"
PIECES["keyed"] = (("tick",), _KEYED)
_CUT = {"previous": 43_200, "signal": 64_800, "execution": 65_400}


def _cutoffs(spark, sf_dir, n: int = 3):
    t = views.ticks(spark, sf_dir)
    keyed = t.select("user_id", "market_start_s").distinct()
    return t, joins.explode_cutoffs(keyed, {k: F.col("market_start_s") + v for k, v in list(_CUT.items())[:n]}, "at")


@query("q_exact_snapshot_join", sql("SELECT k.user_id, k.market_start_s, h.\"at\", x.value FROM keyed k CROSS JOIN LATERAL (SELECT k.market_start_s + unnest([3600, 43200, 64800]) * 1 AS \"at\") h LEFT JOIN (SELECT user_id, t - t % 60 AS \"at\", arg_min(value, event_id) AS value FROM tick GROUP BY 1, 2) x ON x.user_id = k.user_id AND x.\"at\" = h.\"at\"", "keyed", doubles="value"))
def exact_snapshot(spark, sf_dir):
    t = views.ticks(spark, sf_dir)
    keyed = t.select("user_id", "market_start_s").distinct()
    cut = joins.explode_cutoffs(keyed, {str(s): F.col("market_start_s") + s for s in (3600, 43200, 64800)}, "at").drop("cutoff")
    return joins.exact_join(cut, t.withColumn("at", F.col("t") - F.col("t") % 60).select("user_id", "at", "event_id", "value"), ["user_id", "at"]).select("user_id", "market_start_s", "at", "value")


@query("q_asof_backward_topk", sql("SELECT user_id, market_start_s, cutoff, \"at\", t AS tick_t, event_id, value FROM (SELECT k.user_id, k.market_start_s, c.cutoff, k.market_start_s + c.s AS \"at\", x.t, x.event_id, x.value, row_number() OVER (PARTITION BY k.user_id, k.market_start_s, c.cutoff ORDER BY x.t DESC, x.event_id DESC) AS r FROM keyed k CROSS JOIN (VALUES ('previous', 43200), ('signal', 64800), ('execution', 65400)) c(cutoff, s) JOIN tick x ON x.user_id = k.user_id AND x.market_start_s = k.market_start_s AND x.t <= k.market_start_s + c.s) WHERE r = 1", "keyed", doubles="value"))
def asof_topk(spark, sf_dir):
    t, cut = _cutoffs(spark, sf_dir)
    return joins.asof_latest(cut, t.withColumnRenamed("t", "tick_t"), ["user_id", "market_start_s"], "at", ["tick_t", "event_id"], ["tick_t", "event_id", "value"])


@query("q_asof_conditional_agg", sql("""SELECT user_id, market_start_s, p.value AS previous_value, s.value AS signal_value, x.value AS execution_value, market_start_s + 64800 - s.t AS staleness, coalesce(market_start_s + 64800 - s.t <= 3600, FALSE) AS fresh FROM (
  SELECT user_id, market_start_s, arg_max({'value': value, 't': t}, (t, event_id)) FILTER (t <= market_start_s + 43200) AS p, arg_max({'value': value, 't': t}, (t, event_id)) FILTER (t <= market_start_s + 64800) AS s, arg_min({'value': value, 't': t}, (t, event_id)) FILTER (t >= market_start_s + 65400) AS x FROM tick GROUP BY 1, 2)""", "tick", doubles="previous_value signal_value execution_value"))
def asof_agg(spark, sf_dir):
    at = lambda s: F.col("market_start_s") + s
    d = joins.asof_agg(views.ticks(spark, sf_dir), ["user_id", "market_start_s"], ["t", "event_id"], ["value", "t"], {"p": at(43_200), "s": at(64_800)}, {"x": at(65_400)})
    late = F.col("market_start_s") + 64_800 - F.col("s.t")
    return d.select("user_id", "market_start_s", F.col("p.value").alias("previous_value"), F.col("s.value").alias("signal_value"), F.col("x.value").alias("execution_value"), late.alias("staleness"), F.coalesce(late <= 3600, F.lit(False)).alias("fresh"))


@query("q_asof_cross_join", sql("SELECT \"at\", count(*) AS n_before, arg_max(t, (t, event_id)) AS tick_t, arg_max(event_id, (t, event_id)) AS event_id, arg_max(value, (t, event_id)) AS value FROM (VALUES (1704240000), (1705000000), (1706000000)) c(\"at\") JOIN tick ON t <= \"at\" GROUP BY \"at\"", "tick", doubles="value"))
def asof_cross(spark, sf_dir):
    cut = spark.range(1).select(F.explode(F.array(*map(F.lit, (1704240000, 1705000000, 1706000000)))).alias("at"))
    return joins.asof_cross(cut, views.ticks(spark, sf_dir).withColumnRenamed("t", "tick_t"), "at", ["tick_t", "event_id"], ["tick_t", "event_id", "value"])


@query("q_label_overlay", sql("SELECT m.condition_id, coalesce(l.label, m.outcome_up) AS outcome_up, coalesce(l.label <> m.outcome_up, FALSE) AS mismatch, l.label IS NOT NULL AS overlaid FROM market m LEFT JOIN (SELECT condition_id, max(side) * CAST(1 AS DOUBLE) AS label FROM depth WHERE price > CAST(0.5 AS DOUBLE) GROUP BY 1) l USING (condition_id)", "market", "depth"))
def label_overlay(spark, sf_dir):
    labels = views.depth(spark, sf_dir).where("price > 0.5D").groupBy("condition_id").agg(F.max("side").cast("double").alias("outcome_up"))
    return joins.overlay(views.markets(spark, sf_dir), labels, "condition_id", "outcome_up").select("condition_id", "outcome_up", "mismatch", "overlaid")


@query("q_label_coverage", sql("SELECT condition_id, asset FROM market WHERE condition_id NOT IN (SELECT condition_id FROM depth)", "market", "depth"))
def label_coverage(spark, sf_dir):
    return views.markets(spark, sf_dir).join(views.depth(spark, sf_dir), "condition_id", "left_anti").select("condition_id", "asset")


_SERIES = "series AS (SELECT market_start_s AS t, sum(value) AS value FROM tick GROUP BY 1)"
PIECES["series"] = (("tick",), _SERIES)


@query("q_lag_path_features", sql("""SELECT key, CASE WHEN n = 5 THEN ln(v4 / v0) END AS return_path, CASE WHEN n = 5 THEN ln(v4 / v3) END AS return_last, CASE WHEN n = 5 THEN sqrt((pow(ln(v1 / v0), 2) + pow(ln(v2 / v1), 2) + pow(ln(v3 / v2), 2) + pow(ln(v4 / v3), 2)) / 4) END AS volatility FROM (
  SELECT k.t AS key, count(s.value) AS n, max(s.value) FILTER (p.range = 0) AS v0, max(s.value) FILTER (p.range = 1) AS v1, max(s.value) FILTER (p.range = 2) AS v2, max(s.value) FILTER (p.range = 3) AS v3, max(s.value) FILTER (p.range = 4) AS v4
  FROM series k CROSS JOIN range(5) p LEFT JOIN series s ON s.t = k.t - 86400 - (4 - p.range) * 86400 GROUP BY 1)""", "series", doubles="return_path return_last volatility"))
def lag_path(spark, sf_dir):
    s = views.ticks(spark, sf_dir).groupBy(F.col("market_start_s").alias("t")).agg(F.sum("value").alias("value"))
    d = s.select(F.col("t").alias("key"), F.col("t").alias("at"))
    return joins.path_features(joins.lag_path(d, s, "key", "at", 5, DAY, lag=DAY), "key", 5)


@query("q_interval_overlap_counts", sql("SELECT account_id, window_id, unique_markets AS n FROM audit", "audit"))
def overlap_counts(spark, sf_dir):
    a = views.activity(spark, sf_dir)
    spans = a.where("activity_type = 'TRADE'").groupBy("account_id", "condition_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    return joins.overlap_counts(spans, "a", "b", START, END, DAYS, ["account_id"])


@query("q_window_range_sums", sql("SELECT account_id, window_id, sum(cash_flow) AS cash_flow, sum(reward_cash) AS reward_cash FROM cash JOIN windows ON t BETWEEN s AND e GROUP BY 1, 2", "windows", doubles="cash_flow reward_cash"))
def window_range_sums(spark, sf_dir):
    return joins.range_sums(audit.with_cash(views.activity(spark, sf_dir)), "t", ["cash_flow", "reward_cash"], START, END, DAYS, ["account_id"])


@query("q_cross_source_diff", sql("""SELECT condition_id, a AS left_value, b AS right_value, CASE WHEN l IS NULL THEN 'right' WHEN r IS NULL THEN 'left' ELSE 'both' END AS present, coalesce(abs(a - b) <= CAST(0.1 AS DOUBLE), FALSE) AS agrees FROM
  (SELECT condition_id, ask_up AS a, 1 AS l FROM top WHERE condition_id % 5 <> 0) FULL JOIN (SELECT condition_id, ask_down AS b, 1 AS r FROM top WHERE condition_id % 7 <> 0) USING (condition_id)""", "top"))
def cross_source(spark, sf_dir):
    t = views.tops(views.depth(spark, sf_dir))
    a = t.where("condition_id % 5 <> 0").select("condition_id", F.col("ask_up").alias("v"))  # two sources that lack different markets
    b = t.where("condition_id % 7 <> 0").select("condition_id", F.col("ask_down").alias("v"))
    return joins.compare(a, b, ["condition_id"], "v", 0.1)


_OLD, _NEW = (f"SELECT DISTINCT user_id * 1000 + (t // 86400) % 1000 AS key FROM tick WHERE event_type = '{k}'" for k in ("error", "signup"))


def _keys(spark, sf_dir, kind: str) -> DataFrame:
    """User and day of the events of a kind."""
    day = F.floor(F.col("t") / DAY) % 1000
    return views.ticks(spark, sf_dir).where(F.col("event_type") == kind).select((F.col("user_id") * 1000 + day).cast("long").alias("key")).distinct()


@query("q_set_differences", sql(f"SELECT key, 'subscribe' AS action FROM ({_NEW} EXCEPT {_OLD}) UNION ALL SELECT key, 'unsubscribe' FROM ({_OLD} EXCEPT {_NEW})", "tick"))
def set_differences(spark, sf_dir):
    return feeds.subscription_delta(_keys(spark, sf_dir, "error"), _keys(spark, sf_dir, "signup"), "key")


@query("q_inventory_diff", sql(f"SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' ELSE 'undeclared' END AS problem FROM ({_NEW}) a FULL JOIN ({_OLD}) b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL", "tick"))
def inventory_diff(spark, sf_dir):
    return joins.inventory_diff(_keys(spark, sf_dir, "signup"), _keys(spark, sf_dir, "error"), "key")


@query("q_inventory_common", sql(f"SELECT key FROM ({_OLD} INTERSECT {_NEW})", "tick"))
def inventory_common(spark, sf_dir):
    return _keys(spark, sf_dir, "error").intersect(_keys(spark, sf_dir, "signup"))


# --- scalars and models ------------------------------------------------------------------------


@query("q_bucketize", sql(f"SELECT {_bin('mid_up')} AS bin, count(*) AS n, min(mid_up) AS low, max(mid_up) AS high FROM top GROUP BY 1", "top", doubles="low high"))
def bucketize(spark, sf_dir):
    return views.tops(views.depth(spark, sf_dir)).groupBy(S.state_bin(F.col("mid_up"), EDGES).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("mid_up").alias("low"), F.max("mid_up").alias("high"))


@query("q_fee_curve", sql("SELECT condition_id, sum(round_even(size * (CAST(0.07 AS DOUBLE) * (price * (1 - price))) * 100000.0, 0) / 100000.0) AS fee, sum(round_even(size * (CAST(0.25 AS DOUBLE) * pow(price * (1 - price), 2)) * 100000.0, 0) / 100000.0) AS old_fee FROM depth GROUP BY 1", "depth", doubles="fee old_fee"))
def fee_curve(spark, sf_dir):
    fee = lambda rate, e: F.sum(S.platform_fee(F.col("size"), F.col("price"), rate, 5, e))
    return views.depth(spark, sf_dir).groupBy("condition_id").agg(fee(0.07, 1.0).alias("fee"), fee(0.25, 2.0).alias("old_fee"))


_WALK = sql("SELECT condition_id, shares_up, shares_down, cost_up, cost_down, fee_up, fee_down FROM result_w", "result", doubles="shares_up shares_down cost_up cost_down fee_up fee_down")


@query("q_fak_depth_walk", _WALK)
def depth_walk(spark, sf_dir):
    return execution.walk(views.depth(spark, sf_dir), R)


@query("q_lookup_model", sql("SELECT * FROM model", "model", doubles="probability_up persistence"))
def lookup_model(spark, sf_dir):
    d = splits.atomic(views.decisions(spark, sf_dir), "market_start_s")
    return models.lookup_model(d.where("split = 'train'"), EDGES)


_STEPS = f"""steps0 AS (SELECT user_id, t, event_id, value / 1000 AS x, lag(value / 1000) OVER (PARTITION BY user_id ORDER BY t, event_id) AS px FROM tick),
steps AS (SELECT {_bin("px")} AS prev_bin, {_bin("x")} AS bin FROM steps0 WHERE px IS NOT NULL)"""
PIECES["steps"] = (("tick",), _STEPS)
PIECES["matrix"] = (("steps",), _transition("matrix", "steps").strip())


def _matrix(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    x = F.col("value") / 1000
    d = views.ticks(spark, sf_dir).withColumns({"x": x, "px": F.lag(x).over(w)}).where("px IS NOT NULL")
    return models.transitions(d, S.state_bin(F.col("px"), EDGES), S.state_bin(F.col("x"), EDGES), 10)


@query("q_transition_matrix", sql("SELECT * FROM matrix", "matrix", doubles="p"))
def transition_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir)


@query("q_literal_one_step", sql("SELECT prev_bin AS bin, sum(p * (CASE WHEN bin = 9 THEN (CAST(0.9 AS DOUBLE) + CAST(1.000001 AS DOUBLE)) / 2 ELSE (CAST(bin AS DOUBLE) / 10 + CAST(bin + 1 AS DOUBLE) / 10) / 2 END)) AS expected_mid FROM matrix GROUP BY 1", "matrix", doubles="expected_mid"))
def literal_one_step(spark, sf_dir):
    return models.literal_one_step(_matrix(spark, sf_dir), EDGES)


_LOGIT = ["logit_mid_up", "mid_change", "spread_up", "spread_down"]


@query("q_logistic_scores")
def logistic_scores(spark, sf_dir):
    d = models.price_features(splits.atomic(views.decisions(spark, sf_dir).where("snapshot_valid AND outcome_up IS NOT NULL"), "market_start_s"))
    age = (F.lit(904_694_400) - F.col("market_start_s")) / DAY
    train = d.where("split = 'train'").withColumn("weight", S.recency_weight(age, 365.0))
    fitted = models.fit_logistic(train, _LOGIT, "outcome_up", "weight")[0]
    scored = models.predict_logistic(d.where("split <> 'train'"), _LOGIT, fitted, 0.001, 0.999)
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("probability_up").alias("mean_p"), F.avg(S.brier(F.col("probability_up"), F.col("outcome_up"))).alias("brier"), F.avg(S.log_loss(F.col("probability_up"), F.col("outcome_up"))).alias("log_loss"))


# --- evaluation --------------------------------------------------------------------------------

@query("q_gate_cascade", sql("SELECT condition_id, split, bin, probability, support, side, signal_ask, net_edge, status, filled, fill_shares, fill_cost, platform_fee, gross_pnl, net_pnl FROM result", "result", doubles="probability signal_ask net_edge fill_shares fill_cost platform_fee gross_pnl net_pnl"))
def gate_cascade(spark, sf_dir):
    return backtest.evaluated(spark, sf_dir).select("condition_id", "split", "bin", "probability", "support", "side", "signal_ask", "net_edge", "status", "filled", "fill_shares", "fill_cost", "platform_fee", "gross_pnl", "net_pnl")


@query("q_funnel", sql("""SELECT split, count(*) AS markets, count(*) FILTER (g1) AS s1, count(*) FILTER (g1 AND g2) AS s2, count(*) FILTER (g1 AND g2 AND g3) AS s3, count(*) FILTER (g1 AND g2 AND g3 AND g4) AS s4, count(*) FILTER (filled) AS fills, count(*) FILTER (g2) AS only2, count(*) FILTER (g4) AS only4 FROM (
  SELECT *, snapshot_valid AS g1, coalesce(signal_ask BETWEEN CAST(0.01 AS DOUBLE) AND CAST(0.99 AS DOUBLE), FALSE) AS g2, coalesce(persistence >= 0, FALSE) AS g3, coalesce(net_edge >= CAST(0.02 AS DOUBLE), FALSE) AS g4 FROM result) GROUP BY 1""", "result"))
def funnel(spark, sf_dir):
    no = lambda c: F.coalesce(c, F.lit(False))
    d = backtest.evaluated(spark, sf_dir).withColumns({"g1": F.col("snapshot_valid"), "g2": no(F.col("signal_ask").between(0.01, 0.99)), "g3": no(F.col("persistence") >= 0), "g4": no(F.col("net_edge") >= 0.02)})
    steps = [F.count_if(F.expr(" AND ".join(f"g{j}" for j in range(1, k + 1)))).alias(f"s{k}") for k in range(1, 5)]
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("markets"), *steps, F.count_if("filled").alias("fills"), F.count_if("g2").alias("only2"), F.count_if("g4").alias("only4"))


_SUMMARY = """SELECT split, count(*) AS markets, count(*) FILTER (snapshot_valid) AS valid_snapshots, count(*) FILTER (filled) AS fills, sum(gross_pnl) AS gross_pnl, sum(platform_fee) AS platform_fee, sum(extra_cost) AS extra_cost, sum(net_pnl) AS net_pnl,
  sum(greatest(net_pnl, 0)) AS gross_profit, sum(greatest(-net_pnl, 0)) AS gross_loss, sum(CASE WHEN filled THEN fill_cost + platform_fee + extra_cost ELSE 0 END) AS cash_cost, count(*) FILTER (filled AND net_pnl > 0) AS winning_fills, max(drawdown) AS max_drawdown,
  """ + ", ".join(f"count(*) FILTER (status = {k}) AS status_{k}" for k in range(9)) + " FROM path GROUP BY 1"


@query("q_backtest_summary", sql(f"SELECT *, fills / markets AS fill_rate, CASE WHEN cash_cost <> 0 THEN net_pnl / cash_cost END AS return_on_cash, CASE WHEN gross_loss <> 0 THEN gross_profit / gross_loss END AS profit_factor, CASE WHEN fills > 0 THEN winning_fills / fills END AS winning_rate FROM ({_SUMMARY})", "path",
    doubles="gross_pnl platform_fee extra_cost net_pnl gross_profit gross_loss cash_cost max_drawdown fill_rate return_on_cash profit_factor winning_rate"))
def backtest_summary(spark, sf_dir):
    return backtest.backtest_summary(spark, sf_dir)


@query("q_daily_weekly_pnl", sql("""SELECT day, week, day_pnl, fills, sum(day_pnl) OVER (PARTITION BY week) AS week_pnl FROM (SELECT strftime(make_timestamp(market_start_s * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(market_start_s * 1000000), '%G-W%V') AS week, sum(net_pnl) AS day_pnl, count(*) FILTER (filled) AS fills FROM result GROUP BY 1, 2)""", "result", doubles="day_pnl week_pnl"))
def daily_weekly(spark, sf_dir):
    return metrics.daily_weekly(backtest.evaluated(spark, sf_dir))


@query("q_regime_metrics", sql("""SELECT split, count(*) AS markets, count(*) FILTER (filled) AS fills, avg(pow(probability - y, 2)) FILTER (filled) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) FILTER (filled) AS log_loss, avg(probability - y) FILTER (filled) AS calibration_gap, avg(CASE WHEN y > 0.5 THEN 1.0 WHEN y <= 0.5 THEN 0.0 END) FILTER (filled) AS win_rate,
  avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) FILTER (filled) AS up_share, sum(net_pnl) AS net_pnl, sum(net_pnl - CAST(0.01 AS DOUBLE) * fill_shares) AS stress_pnl FROM (SELECT *, CASE WHEN side = 0 THEN outcome_up ELSE 1 - outcome_up END AS y, least(greatest(probability, 1e-12), 1 - 1e-12) AS q FROM result) GROUP BY 1""", "result", doubles="brier log_loss calibration_gap win_rate up_share net_pnl stress_pnl"))
def regime(spark, sf_dir):
    return metrics.regime_metrics(backtest.evaluated(spark, sf_dir), ["split"])


@query("q_chrono_split", sql("SELECT split, count(*) AS n, min(market_start_s) AS first_s, max(market_start_s) AS last_s FROM split GROUP BY 1", "split"))
def chrono_split(spark, sf_dir):
    return splits.atomic(views.decisions(spark, sf_dir), "market_start_s").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("market_start_s").alias("first_s"), F.max("market_start_s").alias("last_s"))


@query("q_positional_split", sql("SELECT split, count(*) AS n, sum(condition_id) AS ids FROM (SELECT condition_id, CASE WHEN r <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM (SELECT condition_id, row_number() OVER (ORDER BY market_start_s, condition_id) AS r, count(*) OVER () AS n FROM market)) GROUP BY 1", "market"))
def positional_split(spark, sf_dir):
    d = splits.positional(views.markets(spark, sf_dir), ["market_start_s", "condition_id"])
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("condition_id").alias("ids"))


PIECES["pairs"] = (("split",), f"pairs AS (SELECT {_bin('previous_mid_up')} AS prev_bin, {_bin('mid_up')} AS bin FROM train WHERE snapshot_valid AND outcome_up BETWEEN 0 AND 1)")
PIECES["literal"] = (("pairs", "model"), _transition("step", "pairs").strip() + """,
literal0 AS (SELECT prev_bin AS bin, sum(p * (CASE WHEN bin = 9 THEN (CAST(0.9 AS DOUBLE) + CAST(1.000001 AS DOUBLE)) / 2 ELSE (CAST(bin AS DOUBLE) / 10 + CAST(bin + 1 AS DOUBLE) / 10) / 2 END)) AS probability_up FROM step GROUP BY 1),
literal AS (SELECT m.bin, l.probability_up, m.support, m.persistence FROM model m JOIN literal0 l USING (bin))""")
_RUNS = [(v, c, m, r, f) for c, extra in backtest.COSTS.items() for v, m, r, f in (("terminal_lookup", "model", R.but(extra_cost=extra), None), ("literal_one_step", "literal", R.but(extra_cost=extra), None), ("range_only", "model", R.but(extra_cost=extra, support_gate=False, persistence_gate=False, edge_gate=False), "CASE WHEN mid_down > mid_up THEN 1 ELSE 0 END"))]
PIECES["variants"] = (("literal",), ",".join(_eval(f"v_{v}_{c}", "test", m, r, forced=f) for v, c, m, r, f in _RUNS).strip() + ", variants AS (" + " UNION ALL BY NAME ".join(f"SELECT *, '{v}' AS variant, '{c}' AS cost FROM v_{v}_{c}" for v, c, *_ in _RUNS) + ")")


@query("q_variants_costs", sql("SELECT variant, cost, count(*) AS markets, count(*) FILTER (filled) AS fills, sum(net_pnl) AS net_pnl FROM variants GROUP BY 1, 2", "variants", doubles="net_pnl"))
def variants_costs(spark, sf_dir):
    return backtest.variants(spark, sf_dir).groupBy("variant", "cost").agg(F.count(F.lit(1)).alias("markets"), F.count_if("filled").alias("fills"), F.sum("net_pnl").alias("net_pnl"))


# --- ordered metrics ---------------------------------------------------------------------------


@query("q_rolling_24h", sql("SELECT event_id, (SELECT sum(b.value) FROM tick b WHERE b.user_id = a.user_id AND b.t >= a.t - 86400 AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id))) AS rolling FROM tick a", "tick", doubles="rolling"))
def rolling_24h(spark, sf_dir):
    return metrics.rolling_time_sum(views.ticks(spark, sf_dir), "value", "t", "event_id", DAY, ["user_id"]).select("event_id", "rolling")


@query("q_rolling_20", sql("SELECT event_id, CASE WHEN row_number() OVER w >= 20 THEN avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS rolling_mean FROM tick WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)", "tick", doubles="rolling_mean"))
def rolling_20(spark, sf_dir):
    return metrics.rolling_count_mean(views.ticks(spark, sf_dir), "value", ["t", "event_id"], 20, ["user_id"]).select("event_id", "rolling_mean")


@query("q_side_concentration", sql("SELECT user_id, coalesce(max(greatest(m, 1 - m)), greatest(avg(f), 1 - avg(f))) AS concentration, count(*) AS n FROM (SELECT user_id, f, CASE WHEN row_number() OVER w >= 20 THEN avg(f) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS m FROM (SELECT *, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS f FROM tick) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) GROUP BY 1", "tick", doubles="concentration"))
def side_concentration(spark, sf_dir):
    return metrics.concentration(views.ticks(spark, sf_dir).withColumn("f", F.col("value") > 50), "f", ["t", "event_id"], 20, ["user_id"])


@query("q_longest_streak", sql("SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(c) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) THEN 0 ELSE 1 END AS c FROM tick)) GROUP BY 1, 2) GROUP BY 1", "tick"))
def longest_streak(spark, sf_dir):
    return metrics.longest_streak(views.ticks(spark, sf_dir), "event_type", ["t", "event_id"], ["user_id"])


PIECES["walked"] = (("tick",), """walk0 AS (SELECT user_id, t, event_id, sum(value - 50) OVER (PARTITION BY user_id ORDER BY t, event_id) AS cum FROM tick),
walked AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY user_id ORDER BY t, event_id)) AS peak, greatest(0, max(cum) OVER (PARTITION BY user_id ORDER BY t, event_id)) - cum AS drawdown FROM walk0),
trough AS (SELECT user_id, t AS trough_t, event_id AS trough_id, peak AS prior_peak, drawdown AS max_drawdown FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY drawdown DESC, t, event_id) AS r FROM walked) WHERE r = 1)""")


@query("q_drawdown_recovery", sql("SELECT b.user_id, b.max_drawdown, b.trough_t, min(w.t) - b.trough_t AS recovery_seconds FROM trough b LEFT JOIN walked w ON w.user_id = b.user_id AND (w.t > b.trough_t OR (w.t = b.trough_t AND w.event_id > b.trough_id)) AND w.cum >= b.prior_peak AND b.max_drawdown > 0 GROUP BY b.user_id, b.max_drawdown, b.trough_t", "walked", doubles="max_drawdown"))
def drawdown_recovery(spark, sf_dir):
    p = metrics.running(views.ticks(spark, sf_dir).withColumn("gain", F.col("value") - 50), "gain", "t", "event_id", ["user_id"], bucket=7 * DAY)
    return metrics.recovery(p, "t", "event_id", ["user_id"])


@query("q_capital_ledger", sql("SELECT condition_id, before + 1000 AS capital_before, cum + 1000 AS capital_after, peak + 1000 AS capital_peak, drawdown, drawdown / (peak + 1000) AS drawdown_fraction, CASE WHEN before + 1000 <> 0 THEN outlay / (before + 1000) END AS outlay_fraction, outlay <= before + 1000 AS funded FROM (SELECT *, fill_cost + platform_fee + extra_cost AS outlay, greatest(0, max(cum) OVER (ORDER BY market_start_s, condition_id)) AS peak, greatest(0, max(cum) OVER (ORDER BY market_start_s, condition_id)) - cum AS drawdown, cum - net_pnl AS before FROM (SELECT *, sum(net_pnl) OVER (ORDER BY market_start_s, condition_id) AS cum FROM result WHERE split = 'test' AND filled))", "result",
    doubles="capital_before capital_after capital_peak drawdown drawdown_fraction outlay_fraction"))
def capital_ledger(spark, sf_dir):
    d = backtest.evaluated(spark, sf_dir).where("split = 'test' AND filled").withColumn("outlay", F.col("fill_cost") + F.col("platform_fee") + F.col("extra_cost"))
    out = metrics.ledger(d, "net_pnl", "outlay", "market_start_s", "condition_id", 1000.0)
    return out.select("condition_id", "capital_before", "capital_after", "capital_peak", "drawdown", "drawdown_fraction", "outlay_fraction", "funded")


@query("q_ledger_extremes", sql("SELECT split, arg_max(condition_id, (net_pnl, condition_id)) AS best_id, max(net_pnl) AS best, arg_min(condition_id, (net_pnl, condition_id)) AS worst_id, min(net_pnl) AS worst, avg(net_pnl) AS mean FROM result WHERE filled GROUP BY 1", "result", doubles="best worst mean"))
def ledger_extremes(spark, sf_dir):
    o = F.struct("net_pnl", "condition_id")
    d = backtest.evaluated(spark, sf_dir).where("filled")
    return d.groupBy("split").agg(F.max_by("condition_id", o).alias("best_id"), F.max("net_pnl").alias("best"), F.min_by("condition_id", o).alias("worst_id"), F.min("net_pnl").alias("worst"), F.avg("net_pnl").alias("mean"))


@query("q_gap_check", sql("SELECT user_id, count(*) FILTER (d <> 60) AS n_gaps, max(d) AS largest, count(*) AS n FROM (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS d FROM tick) GROUP BY 1", "tick"))
def gap_check(spark, sf_dir):
    return metrics.gaps(views.ticks(spark, sf_dir), "t", ["user_id"], 60)


@query("q_half_split", sql("SELECT user_id, sum(CASE WHEN r <= n // 2 THEN value ELSE 0 END) AS half1, sum(CASE WHEN r > n // 2 THEN value ELSE 0 END) AS half2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM tick) GROUP BY 1", "tick", doubles="half1 half2"))
def half_split(spark, sf_dir):
    return metrics.halves(views.ticks(spark, sf_dir), "value", ["t", "event_id"], ["user_id"])


@query("q_change_points", sql("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM tick) WHERE p <> event_type", "tick"))
def change_points(spark, sf_dir):
    return metrics.boundaries(views.ticks(spark, sf_dir), "event_type", ["t", "event_id"], ["user_id"]).select("user_id", "event_id", "event_type")


# --- search ------------------------------------------------------------------------------------

_CELL = "cell_id, fills, net_pnl, gross_profit, gross_loss, stress_pnl"


@query("q_grid_metrics", sql(f"SELECT fold_id, {_CELL}, half1_pnl, half2_pnl FROM grid", "grid", doubles="net_pnl gross_profit gross_loss stress_pnl half1_pnl half2_pnl"))
def grid_metrics(spark, sf_dir):
    return grid_search.fold_metrics(spark, sf_dir).select("fold_id", *_CELL.split(", "), "half1_pnl", "half2_pnl")


@query("q_fold_pool", sql(f"SELECT {_CELL}, positive_folds, positive_stress_folds, profit_factor FROM pool", "pool", doubles="net_pnl gross_profit gross_loss stress_pnl profit_factor"))
def fold_pool(spark, sf_dir):
    return grid_search.pooled(spark, sf_dir).select(*_CELL.split(", "), "positive_folds", "positive_stress_folds", "profit_factor")


@query("q_neighbour_floor", sql("SELECT cell_id, floor_pnl, floor_folds FROM floors", "floor", doubles="floor_pnl"))
def neighbour_floor(spark, sf_dir):
    return search.neighbour_floor(grid_search.pooled(spark, sf_dir)).select("cell_id", "floor_pnl", "floor_folds")


@query("q_plateau", sql("SELECT cell_id, members, median_pnl, median_stress_pnl, median_positive_folds, profitable_fraction, stress_profitable_fraction, minimum_pnl, maximum_pnl FROM plateau", "plateau", doubles="median_pnl median_stress_pnl median_positive_folds profitable_fraction stress_profitable_fraction minimum_pnl maximum_pnl"))
def plateau(spark, sf_dir):
    p = search.plateau(grid_search.pooled(spark, sf_dir))
    return p.select("cell_id", "members", "median_pnl", "median_stress_pnl", "median_positive_folds", "profitable_fraction", "stress_profitable_fraction", "minimum_pnl", "maximum_pnl")


@query("q_selection_topk", sql("""SELECT cell_id, passed, median_pnl, net_pnl, kind FROM (SELECT *, 'eligible' AS kind, row_number() OVER (ORDER BY passed DESC, round(median_pnl, 6) DESC, round(net_pnl, 6) DESC, cell_id) AS r FROM gated WHERE passed = 8) WHERE r <= 25
  UNION ALL SELECT cell_id, passed, median_pnl, net_pnl, kind FROM (SELECT *, 'near_miss' AS kind, row_number() OVER (ORDER BY passed DESC, round(median_pnl, 6) DESC, round(net_pnl, 6) DESC, cell_id) AS r FROM gated WHERE passed = (SELECT max(passed) FROM gated WHERE passed < 8)) WHERE r <= 10""", "gated", doubles="median_pnl net_pnl"))
def selection_topk(spark, sf_dir):
    return grid_search.selected(spark, sf_dir).select("cell_id", "passed", "median_pnl", "net_pnl", "kind")


@query("q_turnover_rollup", sql("SELECT fold_id, asset, count(*) AS trades, sum(fill_cost + platform_fee + extra_cost) AS turnover, max(fill_cost + platform_fee + extra_cost) AS largest, sum(net_pnl) AS net_pnl FROM folds WHERE filled GROUP BY ROLLUP (fold_id, asset)", "folds", doubles="turnover largest net_pnl"))
def turnover_rollup(spark, sf_dir):
    d = grid_search.fold_results(spark, sf_dir).where("filled").withColumn("outlay", F.col("fill_cost") + F.col("platform_fee") + F.col("extra_cost"))
    return d.rollup("fold_id", "asset").agg(F.count(F.lit(1)).alias("trades"), F.sum("outlay").alias("turnover"), F.max("outlay").alias("largest"), F.sum("net_pnl").alias("net_pnl"))


# --- ledger audit ------------------------------------------------------------------------------


@query("q_quantiles", sql("SELECT activity_type, quantile_cont(usdc_size, 0.1) AS p10, quantile_cont(usdc_size, 0.5) AS p50, quantile_cont(usdc_size, 0.9) AS p90, median(price) AS median_price FROM activity GROUP BY 1", "activity", doubles="p10 p50 p90 median_price"))
def quantiles(spark, sf_dir):
    p = lambda x: F.percentile("usdc_size", F.lit(x))
    return views.activity(spark, sf_dir).groupBy("activity_type").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.median("price").alias("median_price"))


@query("q_behaviour", sql("SELECT account_id, count(*) AS trade_rows, count(DISTINCT condition_id) AS unique_markets, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells, " + ", ".join(f"quantile_cont({c}, {q}) AS {c}_p{int(100 * q)}" for c in ("price", "usdc_size") for q in (0.1, 0.5, 0.9)) + " FROM activity WHERE activity_type = 'TRADE' GROUP BY 1", "activity", doubles=" ".join(f"{c}_p{q}" for c in ("price", "usdc_size") for q in (10, 50, 90))))
def behaviour(spark, sf_dir):
    return audit.behaviour(views.activity(spark, sf_dir))


@query("q_settled_pnl_having", sql("SELECT * FROM settled", "settled", doubles="pnl"))
def settled(spark, sf_dir):
    return audit.settled(views.activity(spark, sf_dir))


@query("q_window_metrics", sql("SELECT * FROM audit", "audit", doubles="cash_flow reward_cash pnl biggest_win"))
def window_metrics(spark, sf_dir):
    return audit.window_metrics(views.activity(spark, sf_dir), START, END, DAYS)


_CLAIM = (5000.0, 150, 300.0, 500.0, 50.0)
PIECES["claim"] = (("audit",), """claim AS (SELECT *, abs(near - 5000) / 5000 + least(abs(trades - 150), abs(unique_markets - 150), abs(resolved - 150)) / 150 + abs(biggest_win - 300) / 300 AS distance, abs(near - 5000) <= 500 AS pnl_match,
  abs(near - 5000) <= 500 AND abs(biggest_win - 300) <= 50 AND (trades = 150 OR unique_markets = 150 OR resolved = 150) AS joint FROM (SELECT *, CASE WHEN abs(pnl - 5000) <= abs(pnl + reward_cash - 5000) THEN pnl ELSE pnl + reward_cash END AS near FROM audit))""")


@query("q_claim_match", sql("SELECT account_id, arg_min(window_id, (distance, window_id)) AS window_id, min(distance) AS distance, arg_min(near, (distance, window_id)) AS nearest_pnl, bool_or(joint) AS verified, count(*) FILTER (pnl_match) AS pnl_matches FROM claim GROUP BY 1", "claim", doubles="distance nearest_pnl"))
def claim_match(spark, sf_dir):
    w = audit.window_metrics(views.activity(spark, sf_dir), START, END, DAYS)
    return audit.best_claim(audit.claim_distance(w, *_CLAIM))


@query("q_exact_dedup", sql("SELECT account_id, count(*) AS n FROM (SELECT DISTINCT * FROM (SELECT account_id, condition_id, t, activity_type, side, usdc_size FROM activity UNION ALL SELECT account_id, condition_id, t, activity_type, side, usdc_size FROM activity)) GROUP BY 1", "activity"))
def exact_dedup(spark, sf_dir):
    c = ["account_id", "condition_id", "t", "activity_type", "side", "usdc_size"]
    a = views.activity(spark, sf_dir).select(*c)
    return audit.exact_rows(a.unionByName(a), c).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))


# --- books and streams -------------------------------------------------------------------------

_CUTOFF = 1_705_276_800_000_000


@query("q_book_depth_declarative", sql(f"""SELECT token, side, price, r.size AS size FROM (SELECT token, side, price, arg_max({{'size': size, 'lim': lim}}, (t, event_id)) AS r FROM (
  SELECT *, CASE WHEN side = 'bid' THEN min(hint) OVER w ELSE max(hint) OVER w END AS lim FROM (SELECT b.*, CASE WHEN kind IN ('snapshot', 'bid', 'best_bid') THEN 'bid' ELSE 'ask' END AS side, CASE WHEN kind IN ('best_bid', 'best_ask') THEN price END AS hint FROM book b JOIN
    (SELECT token, max((t, event_id)) AS st FROM book WHERE kind = 'snapshot' AND t <= {_CUTOFF} GROUP BY 1) s USING (token) WHERE t <= {_CUTOFF} AND (t, event_id) >= st) WINDOW w AS (PARTITION BY token, side ORDER BY t DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE hint IS NULL GROUP BY 1, 2, 3)
  WHERE r.size > 0 AND coalesce(CASE WHEN side = 'bid' THEN price <= r.lim ELSE price >= r.lim END, TRUE)""", "book"))
def book_depth(spark, sf_dir):
    return book.depth_at(views.book_events(spark, sf_dir), _CUTOFF)


@query("q_book_fold_exact")
def book_fold(spark, sf_dir):
    return book.fold(views.book_events(spark, sf_dir))


@query("q_stream_book")
def stream_book(spark, sf_dir):
    return feeds.drain(feeds.books(feeds.event_stream(spark, sf_dir)), "update", "token")


@query("q_stream_health", sql("SELECT kind, count(*) AS messages, min(t) AS first_t, max(t) AS last_t FROM book GROUP BY 1", "book"))
def stream_health(spark, sf_dir):
    return feeds.drain(feeds.health(feeds.event_stream(spark, sf_dir)), "complete", "kind")


@query("q_feed_health", sql("SELECT kind, count(*) AS messages, max(d) AS largest_gap, min(t) AS first_t, max(t) AS last_t FROM (SELECT *, t - lag(t) OVER (PARTITION BY kind ORDER BY t, event_id) AS d FROM book) GROUP BY 1", "book"))
def feed_health(spark, sf_dir):
    return feeds.batch_health(views.book_events(spark, sf_dir))


@query("q_json_levels", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_levels(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit('[["0.5","'), F.get_json_object("props", "$.k"), F.lit('"]]')).alias("j"))
    x = e.select(F.explode(S.levels(F.col("j"))).alias("l")).select(F.col("l.size").cast("long").alias("k"))
    return x.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


#: A message per event: its keys, and its kind by the rules of the feed, in order of precedence.
_MESSAGES = [
    ('{"bids":[],"asks":[],"price_changes":[]}', "book"), ('{"bids":[]}', "unknown"), ('{"priceChanges":[]}', "price_change"), ('{"new_tick_size":"0.01"}', "tick_size_change"),
    ('{"winning_asset_id":"1"}', "market_resolved"), ('{"best_bid":"1","best_ask":"1","spread":"0"}', "best_bid_ask"), ('{"price":"1","side":"BUY"}', "last_trade_price"),
    ('{"topic":"market","type":"best_bid_ask","payload":{"bids":[],"asks":[]}}', "best_bid_ask"), ('{"topic":"market","payload":{}}', "unknown"), ('{"event_type":"book","price":"1","side":"BUY"}', "book"),
]


@query("q_event_infer", f"SELECT kind, count(*) AS n FROM (SELECT CASE event_id % 10 {' '.join(f'WHEN {k} THEN ' + repr(kind) for k, (_, kind) in enumerate(_MESSAGES))} END AS kind FROM events) GROUP BY 1")
def event_infer(spark, sf_dir):
    m = F.element_at(F.array(*(F.lit(text) for text, _ in _MESSAGES)), (F.col("event_id") % 10 + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(m.alias("m"))
    return e.groupBy(S.event_type(F.col("m")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_TITLE = "concat('Will ', CASE p_size % 6 WHEN 0 THEN 'Bitcoin' WHEN 1 THEN 'ETH' WHEN 2 THEN 'sol' WHEN 3 THEN 'XRP' WHEN 4 THEN 'Solstice' ELSE 'bnb' END, ' rise in ', CASE p_size % 5 WHEN 0 THEN '5m' WHEN 1 THEN '15 min' WHEN 2 THEN '1 hour' WHEN 3 THEN '4h' ELSE 'a day' END)"


@query("q_classify", f"""SELECT CASE WHEN regexp_matches(t, '(^|[^a-z])(bitcoin|btc)($|[^a-z])') THEN 'BTC' WHEN regexp_matches(t, '(^|[^a-z])(ethereum|eth)($|[^a-z])') THEN 'ETH' WHEN regexp_matches(t, '(^|[^a-z])(solana|sol)($|[^a-z])') THEN 'SOL' WHEN regexp_matches(t, '(^|[^a-z])xrp($|[^a-z])') THEN 'XRP' WHEN regexp_matches(t, '(^|[^a-z])(bnb|binance coin)($|[^a-z])') THEN 'BNB' ELSE 'OTHER' END AS asset,
CASE WHEN regexp_matches(t, '(^|[^0-9])5 *m') THEN '5m' WHEN regexp_matches(t, '(^|[^0-9])15 *m') THEN '15m' WHEN regexp_matches(t, '(^|[^0-9])1 *h|hourly') THEN '1h' WHEN regexp_matches(t, '(^|[^0-9])4 *h') THEN '4h' ELSE 'UNKNOWN' END AS duration, count(*) AS n FROM (SELECT lower({_TITLE}) AS t FROM part) GROUP BY 1, 2""")
def classify(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr(_TITLE).alias("title"))
    return p.groupBy(S.classify_asset(F.col("title")).alias("asset"), S.classify_duration(F.col("title")).alias("duration")).agg(F.count(F.lit(1)).alias("n"))


@query("q_regime_variants")
def regime_variants(spark, sf_dir):
    from .plans import regimes

    return regimes.comparison(spark, sf_dir)
