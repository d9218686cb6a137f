"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from cutscape.plans import catalog

QUERIES = (
    "profile_basic", "profile_wt", "profile_counts", "symmetric_kl", "topn_class_kl", "overlap", "entropy", "pairwise_report", "merge_samples_outer",
    "top_indels", "pie_categories", "find_mh", "mh_frequencies", "barcode_candidates", "nearby_loci", "wge_choice", "gen_indels", "predict_profile", "edit_details", "full_pairwise",
    "map_reads", "exptargets", "old_new_report", "endogenous_profiles", "endogenous_matrix", "trained_weights",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = catalog.queries()
    catalog.queries()["entropy"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms up
    seconds = {}
    for name in QUERIES:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
