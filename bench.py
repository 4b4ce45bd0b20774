"""Headline queries on $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidecast.plans import catalog
from tidecast.session import local_session

HEADLINE = [
    "win_dedup_txn", "agg_item_day", "agg_wd_hour_ratio", "jn_txn_items", "an_report", "win_outlier_iqr",
    "cal_ratio_summary", "cal_event", "fc_features_shift", "fc_features_item", "fc_shift_split", "fc_chain_blend",
    "jn_actuals_hour", "ld_dedup", "mo_report", "mo_run", "kp_run_errors", "ev_ablation", "bt_report", "ln_bias_keys",
    "ln_apply", "kb_retrieve", "ds_pairs", "st_actuals", "run_daily",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("tidecast-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/orders.parquet").count()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(sf.rstrip("/"))}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
