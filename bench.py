"""Seconds per headline query; prints one JSON line.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``BENCH_CPUS`` cores.
Every query runs once to warm up; the median of the following runs counts, or
the one run where none follows. All
result rows are computed in full and dropped. With query names as arguments,
only those run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from fieldsift.plans.inputs import view
from fieldsift.plans.queries import QUERIES
from fieldsift.session import local_session

# query -> timed runs
HEADLINE = {
    "clean_note": 3,
    "clean_documents": 1,
    "redact_secrets": 3,
    "parse_category": 3,
    "extract_category": 3,
    "predict_notes": 3,
    "valid_notes": 3,
    "dedup_first": 3,
    "duplicate_count": 3,
    "category_distribution": 3,
    "stratified_split": 3,
    "stratified_folds": 3,
    "fewshot_bucket": 3,
    "fewshot_stride": 3,
    "batch_contract": 3,
    "confusion_matrix": 3,
    "classification_report": 3,
    "method_comparison": 3,
    "tiered_scoring": 3,
    "chat_render": 3,
    "ngrams": 3,
    "tfidf_vocab": 1,
    "tfidf": 1,
    "cv_vocabularies": 0,
    "predict_documents": 1,
    "log_write_read": 1,
    "log_category_counts": 3,
    "recent_history": 3,
    "stream_predict": 1,
    "stream_counts": 1,
    "rf_train_score": 0,
}
# Rates: query -> the notes it goes through.
RATES = {
    "clean_note": "v_noisy_notes",
    "clean_documents": "v_notes",
    "parse_category": "v_raw_outputs",
    "tfidf": "v_notes",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    chosen = {n: HEADLINE.get(n, 3) for n in sys.argv[1:]} or HEADLINE
    seconds = {}
    for name, times in chosen.items():
        first = run(name)
        seconds[name] = round(statistics.median([run(name) for _ in range(times)] or [first]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    rates = {
        name: round(view(spark, sf_dir, source).count() / seconds[name])
        for name, source in RATES.items()
        if name in seconds
    }
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "notes_per_second": rates,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
