"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``blended_model_scores`` trains both models with all their trees and
scores the held-out part; the line gives its seconds per tree of both models, which grow
together.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tastegraph import config  # noqa: E402
from tastegraph.plans.catalog import QUERIES  # noqa: E402
from tastegraph.session import drop_scratch, local_session  # noqa: E402

HEADLINE = [
    "read_ratings",
    "item_features",
    "user_features",
    "train_pairs_enriched",
    "eval_pairs_enriched",
    "edges",
    "category_mean_vector",
    "pairs_with_both_vectors",
    "feature_matrix",
    "predictions_out",
    "rmse_eval",
    "cv_fold_rmse",
    "blend_clamp",
    "neighbour_scores",
    "walk_paths",
    "blended_model_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    # Start the JVM's readers and code generation outside the measurement.
    QUERIES["photo_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        drop_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "seconds_per_tree": round(
                    seconds.get("blended_model_scores", 0) / (max(config.MODEL1["trees"], config.MODEL2["trees"])), 3
                ),
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
