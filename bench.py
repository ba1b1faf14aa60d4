"""Headline queries, timed. Prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from vulnwave.catalog import QUERIES  # noqa: E402
from vulnwave.session import local_session  # noqa: E402

HEADLINE = [
    "clean_documents", "clean_text", "article_text", "link", "upsert", "vocabulary_word_pairs", "tfidf_long",
    "tfidf_vectors", "tfidf_sweep", "urgency_score", "top_urgent", "seed_labels", "classification_report",
    "spike_days", "emerging", "weight_sensitivity", "weight_search", "contamination_sweep", "boxplot_by_level",
    "weekly_emerging", "quality_report", "flatten_cve", "isolation_flag_text", "silhouette", "stream_daily_counts",
    "threat_classifier_report",
]


def train_80_trees(spark, sf_dir: str) -> None:
    """Nine categories, 80 trees each, on text and numeric features of the training rows."""
    from vulnwave.catalog import models
    from vulnwave.operators import classify

    features, rows = models._features(spark, sf_dir)
    ready = features.assemble(features.transform(rows), ["text", "numeric"])
    classify.ThreatClassifier.fit(classify.hash_split(ready, "cve_id")[0], "cve_id", trees=80, max_depth=10)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cpus, "bench")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    QUERIES["random_projection"](spark, "/root/testdata/sf0.001").count()  # start Python workers
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        t0 = time.perf_counter()
        train_80_trees(spark, sf_dir)
        times["train_80_trees"] = round(time.perf_counter() - t0, 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "documents", "pages", "events", "embeddings")}
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "rows": rows, "cpus": cpus,
                "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
