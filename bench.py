"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) set the
input and the local master. Each query runs to a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from auditweave.plans import catalog  # noqa: E402
from auditweave.session import build_session  # noqa: E402

HEADLINE = (
    "normalize_mixed_clouds",
    "dead_letters",
    "ip_reputation_and_geo",
    "created_in_window_live",
    "feature_windows",
    "entity_risk",
    "latest_risk_per_entity",
    "federation_stitching",
    "creation_provenance",
    "fuzzy_stitching",
    "entity_purity",
    "merge_audit",
    "benign_rank_threshold",
    "pr_curve",
    "campaign_recall",
    "ablation_without_graph",
    "iforest_scores",
    "phase_scores",
    "alerts_last_5_minutes",
    "alert_report_lines",
    "latest_trust_scores",
    "label_proxy_audit",
    "order_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 1)
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    timings = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        if sys.stderr.isatty() or os.environ.get("BENCH_VERBOSE"):
            print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
