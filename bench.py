"""Times the headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusfreq.catalog import queries
from corpusfreq.session import local_session

HEADLINE = ["word_freq_full", "word_freq_by_category", "freq_norm_groups", "tfidf_weights", "similar_pairs", "dedup_survivors", "cue_clean", "clean_funnel", "pii_counts", "lookup_min", "pearson", "ridge_fit", "js_distance_langs"]


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    all_ = queries()
    all_["word_counts"](spark, d).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in HEADLINE:
        began = time.time()
        all_[name](spark, d).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": d.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
