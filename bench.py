"""Headline queries, timed end to end into a sink that keeps nothing. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINES = [
    "r5_rollup_summary", "r4_area_status", "r9_corpus_rollup", "c7_audit", "v8_assess_validator", "p8_probe_findings", "p12_record_summary",
    "p4_table_header_coverage", "p5_tree_reach", "p13_pages_rollup", "p1_html_elements", "f6_sanitize_pages", "k9_page_contrast", "e2e_measured_rollup",
    "d5_html_draft", "d8_validation_delta", "l4_gate_fsm", "l6_review_sla", "l2_latest_rows", "l12_context_summary", "s1_sequence_events", "s2_snapshot",
    "s10_chunk_blocks", "s19_inline_budget", "f2_short_hash", "f9_search_text", "i3_url_gate", "i7_rate_limit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINES
    from claridoc.plans import catalog
    from claridoc.session import local_session

    spark = local_session(cores, memory="16g", app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["r5_rollup_summary"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(json.dumps({
        "metric": "claridoc_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores, "lineitem_rows": rows,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
