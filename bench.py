"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the no-op sink (full computation, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from talkframe.registry import REGISTRY  # noqa: E402
from talkframe.session import build_session  # noqa: E402
from talkframe.tables import SCAN_PARTITIONS  # noqa: E402

HEADLINE = [
    "tfidf_search", "tfidf_search_filtered", "tfidf_search_multifield", "search_with_text",
    "dense_search_exact", "dense_search_multifield", "nearest_title_gate", "eval_report",
    "rag_batch", "question_explode", "chunk_renumber", "transcript_concat", "chat_pairs",
    "topic_top_words", "topic_pivot", "entity_extract", "html_to_text", "url_episode",
    "catalog_search", "latest_episode", "segment_plan", "hash_encode",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8),
                          # the bench tables are single row groups: deal them to all cores
                          extra={SCAN_PARTITIONS: str(cpus)})
    # warm-up on the smallest tables only (JIT of the regex / array code paths, Python
    # workers, parquet reader); nothing computed here is reused by the measured runs
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in ("tfidf_search", "dense_search_exact"):
        if os.path.isdir(warm_dir):
            REGISTRY[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else None}))


if __name__ == "__main__":
    main()
