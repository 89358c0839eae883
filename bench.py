"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times; the best run counts, results go to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from postmill.session import local_session  # noqa: E402

HEADLINE = (
    "dedup_recipients", "html_to_text", "long_line_profile", "duplicate_bodies", "policy_violations", "unexpected_replies",
    "recipient_counts", "recipient_headers", "reject_reasons", "part_layout", "attachment_dedup", "mime_types", "send_outcome",
    "assemble_replies", "wire_line_audit", "reflow", "tag_balance", "sanitize_pages_html", "connection_sessions", "delivery_rate",
    "render_messages", "header_lines", "embed_assets", "recipient_ledger", "message_size_quoted",
)
# Rows of the table each survey headline reads, for rows per second.
INPUT = {
    "dedup_recipients": ("orders", "lineitem"), "html_to_text": ("pages",), "long_line_profile": ("documents",),
    "duplicate_bodies": ("documents",), "policy_violations": ("pages",), "unexpected_replies": ("events",),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    from postmill.plans.queries import QUERIES

    times = {}
    for name in names:
        best = float("inf")
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = min(best, took) if run else best
        times[name] = round(best, 3)
    rate = {}
    for name, tables in INPUT.items():
        if name in times:
            rows = sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in tables)
            rate[name] = round(rows / times[name])
    spark.stop()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "rows_per_sec": rate, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
