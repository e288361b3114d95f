"""Time the headline queries: one JSON line with seconds per query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "case_outcome_vote",
    "class_distribution",
    "score_density",
    "duplicate_rows",
    "normalize_text",
    "strip_punct",
    "tag_entities",
    "tag_gazetteer",
    "flagged_sentences",
    "determination_sentences",
    "last_block",
    "mask_spans",
    "decision_date_span",
    "reconcile_names",
    "reconcile_dates",
    "token_set_similarity",
    "left_join_fill",
    "gold_join",
    "label_join",
    "feature_outer_join",
    "tail_paragraphs",
    "dedupe_by_key",
    "split_exact",
    "split_hash",
    "oversample",
    "train_set_cover",
    "train_set_all",
    "eval_bundle",
    "f1_macro",
    "confusion_matrix",
    "error_profile",
    "top_words",
    "word_counts",
    "cover_features_from_files",
    "examples_from_corpus",
]
# Timed too, but not part of the total, which stays comparable: training, streams and files.
MORE = ["train_text_clf", "score_text_clf", "stream_tagging", "csv_roundtrip", "merge_shards", "reject_report"]


def main(names):
    from casemill.bindings import QUERIES
    from casemill.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "casemill-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start-up is not part of a query
    runs = int(os.environ.get("BENCH_RUNS", "1"))  # of several runs the median counts

    def timed(name):
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        return round(statistics.median(taken), 3)

    seconds = {name: timed(name) for name in names or HEADLINE}
    more = {} if names else {name: timed(name) for name in MORE}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "more": more,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
