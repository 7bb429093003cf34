"""Headline queries on the driver tables; prints one JSON line.

The first query is run once untimed to start the JVM's code cache (BENCH_WARM=all warms every query); each query is then timed once,
writing to a no-op sink, so that every output row is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_tape", "bars", "trailing_features", "feature_table", "rule_first_match", "labelled_trades", "rule_screen", "exit_sweep",
    "asof_next_event", "pool_quotes", "running_drawdown", "event_features", "ownership_concentration", "wallet_rollup", "wallet_tape_profile",
    "matched_accounts", "stress_replay", "account_admission", "stream_bars",
]


def main() -> None:
    from tapelab.plans import load_registry
    from tapelab.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warm = HEADLINE if os.environ.get("BENCH_WARM") == "all" else HEADLINE[:1]
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "tapelab-bench")
    queries, _ = load_registry()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        run = lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        if name in warm:
            run()
        t0 = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - t0, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "events": events,
                      "rows_per_sec": {n: round(events / s) for n, s in seconds.items() if s > 0}}))


if __name__ == "__main__":
    main()
