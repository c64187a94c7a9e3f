"""Times the named queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "spending_summary", "receipt_lookup", "customer_profiles", "top_departments", "product_catalog", "dedup_items",
    "items_per_receipt", "dq_receipts", "dq_items", "fuzzy_search", "bulk_fuzzy_search", "card_window_lookup",
    "trigram_store_match", "receipt_detail", "customer_history", "recent_receipts", "customer_context", "rep_briefing",
    "semantic_search", "knn_join", "semantic_receipts", "cell_search", "gap_anti_join", "change_feed",
    "hot_cold_receipts", "audit_rows", "redact_json", "throttle_violations", "session_activity",
    "rebuild_line_items", "keyword_product_match", "purchase_frequency", "receipt_stats", "line_item_stats",
    "write_upsert", "clustered_write", "explode_receipts", "stream_bronze", "stream_sync", "migrate_backup_to_bronze", "ann_lsh",
    "migrate_job", "knn_join_lsh", "sync_changes", "zorder_write",
)


def main() -> None:
    from tillworks.registry import QUERIES
    from tillworks.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    for name in ("dedup_receipts", "clean_items", "session_activity", "vector_topk"):  # touches every table once
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
