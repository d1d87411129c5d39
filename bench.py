"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinfold.plans import views  # noqa: E402
from twinfold.plans.catalog import queries  # noqa: E402
from twinfold.session import local_session  # noqa: E402

HEADLINE = [
    "exact_dup_alerts", "exact_dup_alerts_registry", "registry_insert", "find_by_hash",
    "cross_user_pairs", "cross_user_one", "cross_user_two", "cross_user_totals", "duplicate_groups", "duplicate_report",
    "extract_text", "term_frequency", "idf_weights", "tfidf_norms",
    "near_dup_pairs", "near_dup_groups", "text_best_match", "text_dup_alerts",
    "vector_fingerprint", "hamming_pairs", "video_fingerprints", "video_pairs",
    "list_all", "search_keyword", "search_type", "search_user", "search_dates", "search_size_min", "date_week", "preview_top20",
    "alert_status_current", "alerts_pending", "alerts_since", "stats", "alert_messages",
    "utterance_intents", "intent_counts", "utterance_routed",
    "monitor_alerts", "stream_exact_alerts", "alert_feed", "stats_feed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "twinfold-bench")
    catalog = queries()
    names = sys.argv[1:] or HEADLINE
    catalog["vector_fingerprint"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not a query
    start = time.perf_counter()
    views.downloads(spark, sf_dir)
    seconds = {"registry_build": round(time.perf_counter() - start, 3)}
    start = time.perf_counter()
    views.corpus(spark, sf_dir)
    seconds["corpus_build"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
