"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans.queries import QUERIES

HEADLINE = ("bm25_topk", "bm25_two_field", "dense_topk", "rrf_fusion", "rerank_features", "table_sum", "table_avg", "table_diff", "fiscal_year_sum", "parse_number_roundtrip", "project_rollup_counts", "graph_two_hop", "running_header_detect", "topic_words", "chunks", "phash_hamming", "events_tumbling", "events_session")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
