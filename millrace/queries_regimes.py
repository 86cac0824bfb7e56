"""All regime measures of each fold in one table, and of a sub-period."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import ordered
from .plans import grid_search
from .queries import query, sql
from .sources.scratch import kept

#: The sub-period: the second half of 1998.
BAD = (899_251_200, 915_148_800)


def _table(src: str, by: str, order: str = "market_start_s, condition_id") -> str:
    """SQL of the nineteen measures of a table of results."""
    w = f"OVER (PARTITION BY {by} ORDER BY {order})"
    return f"""(WITH a AS (SELECT *, sum(net_pnl) {w} AS cum, CASE WHEN side = 0 THEN outcome_up ELSE 1 - outcome_up END AS y FROM {src}), b AS (SELECT *, greatest(0, max(cum) {w}) AS peak FROM a), c AS (SELECT *, peak - cum AS drawdown FROM b),
  m AS (SELECT {by}, count(*) AS markets, count(*) FILTER (filled) AS fills, avg(pow(probability - y, 2)) FILTER (filled) AS brier, avg(-(y * ln(least(greatest(probability, 1e-12), 1 - 1e-12)) + (1 - y) * ln(least(greatest(1 - probability, 1e-12), 1 - 1e-12)))) FILTER (filled) AS log_loss, avg(probability - y) FILTER (filled) AS calibration_gap,
    avg(CASE WHEN y > 0.5 THEN 1.0 WHEN y <= 0.5 THEN 0.0 END) FILTER (filled) AS win_rate, avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) FILTER (filled) AS up_share, sum(net_pnl) AS net_pnl, sum(net_pnl - CAST(0.01 AS DOUBLE) * fill_shares) AS stress_pnl, sum(CASE WHEN filled THEN fill_cost + platform_fee + extra_cost ELSE 0 END) AS cash_turnover, max(drawdown) AS max_drawdown,
    count(*) FILTER (filled) / greatest((max(market_start_s) - min(market_start_s)) / CAST(86400 AS DOUBLE), CAST(1 AS DOUBLE) / 288) AS fills_per_day, sum(greatest(net_pnl, 0)) AS won, sum(greatest(-net_pnl, 0)) AS lost FROM c GROUP BY 1),
  t AS (SELECT {by}, market_start_s AS trough_t, condition_id AS trough_id, peak AS prior, drawdown AS fall FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY drawdown DESC, {order}) AS r FROM c) WHERE r = 1),
  k AS (SELECT t.{by}, min(c.market_start_s) - t.trough_t AS recovery_seconds FROM t JOIN c ON c.{by} = t.{by} AND (c.market_start_s > t.trough_t OR (c.market_start_s = t.trough_t AND c.condition_id > t.trough_id)) AND c.cum >= t.prior AND t.fall > 0 GROUP BY t.{by}, t.trough_t),
  d AS (SELECT {by}, market_start_s AS day, sum(net_pnl) AS p FROM {src} GROUP BY 1, 2), n AS (SELECT c.{by}, min(c.cum - coalesce(z.before, 0)) AS worst_rolling_24h FROM c LEFT JOIN (SELECT x.{by}, x.market_start_s, sum(d.p) AS before FROM (SELECT DISTINCT {by}, market_start_s FROM {src}) x JOIN d ON d.{by} = x.{by} AND d.day < x.market_start_s - 86400 GROUP BY 1, 2) z ON z.{by} = c.{by} AND z.market_start_s = c.market_start_s GROUP BY 1),
  f AS (SELECT *, CASE WHEN side = lag(side) {w} THEN 0 ELSE 1 END AS new, CASE WHEN row_number() {w} >= 20 THEN avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS share FROM {src} WHERE filled),
  s AS (SELECT {by}, max(n) AS longest_streak FROM (SELECT {by}, run, count(*) AS n FROM (SELECT {by}, sum(new) {w} AS run FROM f) GROUP BY 1, 2) GROUP BY 1), v AS (SELECT {by}, coalesce(max(greatest(share, 1 - share)), greatest(avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END), 1 - avg(CASE WHEN side = 0 THEN 1.0 ELSE 0.0 END))) AS rolling_20_share FROM f GROUP BY 1)
  SELECT m.* EXCLUDE (won, lost), CASE WHEN cash_turnover <> 0 THEN net_pnl / cash_turnover END AS return_on_turnover, CASE WHEN lost <> 0 THEN won / lost END AS profit_factor, won > 0 AND lost = 0 AS profit_factor_infinite, recovery_seconds, worst_rolling_24h, CAST(coalesce(longest_streak, 0) AS BIGINT) AS longest_streak, rolling_20_share
  FROM m LEFT JOIN k USING ({by}) LEFT JOIN n USING ({by}) LEFT JOIN s USING ({by}) LEFT JOIN v USING ({by}))"""


_REAL = "brier log_loss calibration_gap win_rate up_share net_pnl stress_pnl cash_turnover max_drawdown fills_per_day return_on_turnover profit_factor worst_rolling_24h rolling_20_share".split()
_ALL = ["markets", "fills", *_REAL, "profit_factor_infinite", "recovery_seconds", "longest_streak"]


@query("q_regime_table", sql(f"""SELECT w.*, positive_folds, {", ".join(f"b.{c} AS bad_{c}" for c in _ALL)} FROM {_table("(SELECT * FROM folds)", "asset")} w LEFT JOIN (SELECT asset, count(*) FILTER (p > 0) AS positive_folds FROM (SELECT asset, fold_id, sum(net_pnl) AS p FROM folds GROUP BY 1, 2) GROUP BY 1) g USING (asset)
  LEFT JOIN {_table(f"(SELECT * FROM folds WHERE market_start_s >= {BAD[0]} AND market_start_s < {BAD[1]})", "asset")} b USING (asset)""", "folds", doubles=" ".join([*_REAL, *(f"bad_{c}" for c in _REAL)])))
def regime_table(spark, sf_dir):
    """Nineteen measures of each asset's trades over all folds, how many folds earned, and the measures of a bad half year."""
    d = kept(grid_search.fold_results(spark, sf_dir))
    t = ordered.with_sub_period(d, ["asset"], "fold_id", *BAD)
    return t.select("asset", *_ALL, "positive_folds", *(F.col(f"bad_{c}") for c in _ALL))
