"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from vectrill.plans import all_queries

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = [
    "knn_exact", "knn_cosine_filtered", "knn_batch", "vec_join_threshold", "faceted_search", "temporal_search", "hybrid_search", "semantic_keyword", "multi_vector_search", "rrf_fusion", "dense_sparse_search", "bm25_corpus",
    "chunk_fixed", "vector_distances", "vector_avg_by_label", "quantize_codes", "outliers_zscore", "drift", "davies_bouldin", "graph_pagerank", "linear_regression", "naive_bayes_predict", "cluster_kmeans",
    "pricing_summary", "top_orders", "revenue_by_nation", "ranked_orders", "as_of_purchases", "user_sessions",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    spark.read.parquet(f"{SF}/embeddings.parquet").count()  # starts executors and the Parquet reader
    took = {}
    for name in HEADLINES:
        began = time.time()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("/sf", 1)[-1], "cpus": int(CPUS), "spark": spark.version, "vectors": vectors}))


if __name__ == "__main__":
    main()
