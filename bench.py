"""Time the headline queries; prints one JSON line.

Each query is written to Spark's no-op sink, so that all rows and columns are
computed. One run warms up, the median of three counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandcut.plans.catalog import QUERIES  # noqa: E402
from strandcut.session import get_session  # noqa: E402

HEADLINE = [
    "char_spans", "spans_json", "running_number", "predicted_index", "slice_windows", "slice_payload",
    "slice_image", "count_windows", "sequence_pack", "context_features", "contact_sheet", "label_expand",
    "apply_labels", "clean_lines", "dense_index", "train_test_split", "oversample", "shuffle_order",
    "ink_profile", "smooth_profile", "otsu", "accuracy_batch_mean", "weighted_ce", "epoch_summary",
    "picture_ink", "picture_slices", "two_views", "score_linear", "mlp_head", "gated_fusion", "contrastive_logits", "info_nce",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = sys.argv[1:] or HEADLINE
    spark = get_session(
        "strandcut-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:] or taken), 4)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
