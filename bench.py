"""Time the headline queries and print one JSON line.

Settings: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads), or query names as arguments.
Every result is computed in full and thrown away by Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from signalcheck.queries import QUERIES  # noqa: E402
from signalcheck.session import build_session  # noqa: E402

HEADLINE = (
    "repetitive_documents clean_text tokenize lemmatize stem_tokens term_counts tfidf_weights sentiment_lexicon "
    "emotion_lexicon embed_batch describe_numeric histogram_50 box_stats corr_matrix pair_bins_by_class percentile_flag "
    "category_codes centroid_distance kmeans_anomaly dbscan_noise_vectors duplicate_noise autoencoder_anomaly "
    "union_suspects evidence_topk incremental_verify join_verdict_features training_set"
).split()


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{times[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
