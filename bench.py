"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import importlib
import json
import os
import time

from tallyforge.session import forget, local_session

HEADLINE = [
    "release_statistics", "evidence_links_one_sided", "references_by_direction", "shape_faults", "issue_extracts", "quotes_by_overlap", "record_shape_violations", "listing_history", "rule_mentions", "first_fix_after_blocker",
    "script_findings", "similarity_edges", "orders_with_lines", "order_chains", "p3_found", "p4_found",
    "p1_found", "p2_found", "p5_found", "p6_found", "p7_mixture", "p8_found",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    known = importlib.import_module("__spark_entry__").queries()
    spark.range(1000).groupBy("id").count().write.format("noop").mode("overwrite").save()
    took = {}
    for name in (n for n in HEADLINE if n in known):
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        forget(spark)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
