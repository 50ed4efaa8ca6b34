"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemark.plans import catalog

HEADLINE = ["sr_hybrid", "sr_keyword_topk", "sr_vector_topk", "w_chunks", "agg_cards", "agg_latency_backend", "dml_upsert_files", "st_coalesced", "emb_hashing"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.session.timeZone": "UTC", "spark.log.level": "ERROR"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    took = {}
    for name in HEADLINE:
        best = []
        for _ in range(2):
            began = time.perf_counter()
            catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        took[name] = round(min(best), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
