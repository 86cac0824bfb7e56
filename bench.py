"""Times the headline queries, warm, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.catalog import QUERIES  # noqa: E402
from millrace.session import session  # noqa: E402

HEADLINE = ["q_backtest_summary", "q_gate_cascade", "q_grid_metrics", "q_plateau", "q_selection_topk", "q_variants_costs", "q_fak_depth_walk", "q_asof_conditional_agg", "q_asof_backward_topk", "q_lookup_model", "q_transition_matrix", "q_rolling_24h", "q_capital_ledger", "q_window_metrics", "q_book_depth_declarative", "q_book_fold_exact", "q_regime_variants", "q_grid_5d", "q_grid_uniform", "q_replay_depth"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):  # the second counts
            spark.catalog.clearCache()
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
