"""Time the headline queries and print one line of JSON.

Each query runs once to warm up and then ``BENCH_RUNS`` times (1 unless set);
the output of a run is forced by a ``noop`` write and the median is kept.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.queries import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = (
    "log_stats_tag", "log_job_issues", "log_tail_budget", "job_steps", "fact_cashflow", "fact_income", "note_catalog",
    "sync_classify", "sync_apply", "vec_knn", "kw_postings", "kw_bm25", "hybrid_search", "cur_pack", "ctx_prefix",
    "page_text", "page_paywall", "text_redact", "text_chunks", "fin_asof_rows", "fin_metrics", "rate_audit",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        seconds = []
        for i in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.perf_counter() - start)
        times[name] = round(statistics.median(seconds), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
