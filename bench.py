"""Times the headline queries after one untimed query; prints one JSON line."""
import json
import os
import time

from pyspark.sql import SparkSession

from chronorank.plans import catalogue, wide

HEADLINE = ("dst_popularity_scaled", "pair_counts", "bucketed_trend", "recency_pair_asof", "recency_block", "history_last_n", "transition_topk", "cooc_capped_topk", "base_features", "heuristic_scorer", "row_zscore", "probability_rows", "rank_blend", "mrr_three_rules")
ALSO = ("wide_recency", "fitted_features", "nearest_vectors", "weight_grid")  # not in the total, which stays comparable

if __name__ == "__main__":
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    known, took = catalogue.queries() | wide.queries(), {}
    known["edge_row_count"](spark, sf).collect()  # starts what any first query starts
    for name, f in ((n, known[n]) for n in (*HEADLINE, *ALSO)):
        began = time.time()
        f(spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
