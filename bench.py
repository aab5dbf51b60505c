"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times into a no-op sink; the median
counts. BENCH_ALL=1 times every registered query once, and BENCH_NUMBERED=1 also the
numbered ones, which are not part of the sum.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from lexweave.plans.all import QUERIES
from lexweave.session import local_session

HEADLINE = [
    "preprocess", "clean_text", "render_template", "split_default", "global_rank",
    "assign_batches", "chunk_fixed", "chunk_recursive", "hash_embed", "similarity_search",
    "stuff_prompt", "mmr_search", "top_k_l2", "vocabulary", "tokenize_words", "collate_lm",
    "collate_dpo", "assemble_conversations", "compare_runs", "early_stop", "evaluate_dataset",
]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.conf.set("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
    everything = bool(os.environ.get("BENCH_ALL"))
    repeats = 1 if everything else 3
    times = {}
    for name in QUERIES if everything else HEADLINE:
        seconds(spark, sf_dir, name)
        runs = [seconds(spark, sf_dir, name) for _ in range(repeats)]
        times[name] = round(statistics.median(runs), 3)
    numbered = {}
    if os.environ.get("BENCH_NUMBERED"):
        from lexweave.llm import queries

        for name, query in queries.QUERIES.items():
            start = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            numbered[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": cpus,
                **({"numbered": numbered} if numbered else {}),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
