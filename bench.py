"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed fully through the ``noop`` sink (no collect to the
driver). A small warm-up on the smallest scale runs first, untimed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "threshold_sweep", "annotate_wide", "pair_topics", "question_answer_pairs", "label_replace_chain",
    "events_label_metrics", "hash_embed", "medoid_median", "standardize", "silhouette_euclid",
    "silhouette_cosine", "alpha_interval", "observed_agreement", "topic_terms", "answer_bag",
    "main_question", "kmeans_sweep", "best_k_by_count", "count_above_mean", "item_positions", "reduce_pca",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from colloquy.catalog import all_queries
    from colloquy.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                      conf={"spark.driver.memory": "12g"})
    qs = all_queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in qs]
    warm = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    for w in ("threshold_sweep", "hash_embed"):  # JVM and Python workers warm, untimed
        qs[w](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    print(json.dumps({"metric": "total_headline_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
