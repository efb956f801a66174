"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logwarden.plans import catalog  # noqa: E402
from logwarden.session import get_session  # noqa: E402

HEADLINE = (
    "syslog_parse", "apache_parse", "nginx_parse", "sysmon_parse", "windows_parse", "parse_dispatch",
    "detect_formats", "event_iocs", "ioc_dedup", "text_iocs", "ioc_email", "classify", "incidents", "pipeline_stats",
    "severity_breakdown", "top_techniques", "top_source_ips", "upsert_iocs", "log_run", "statistics", "run_summary",
    "ingest_files", "stream_logs",
    "validate_docs", "doc_hash_dedup", "chunk_docs", "bm25_terms", "bm25_search", "dense_search", "rrf_fuse",
    "hybrid_search", "bm25_block_search", "similar_vectors", "similar_vectors_by_cells", "classify_by_rule_table", "address_blocks",
    "search_iocs_indexed",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    catalog.queries()["recent_activity"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    first: dict[str, float] = {}
    times: dict[str, float] = {}
    for name in names:
        for runs in (first, times):  # the second run of a query is the one that counts
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rate = round(lines / times["syslog_parse"]) if "syslog_parse" in times else None
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "first_runs": first, "sf": sf_dir.rstrip("/").split("/")[-1].removeprefix("sf"),
                      "lines": lines, "syslog_lines_per_sec": rate}))


if __name__ == "__main__":
    main()
