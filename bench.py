"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from arealis.plans import QUERIES

HEADLINE = [
    "ag2_flag_sums_and_mean_ages",
    "rt4_direct_standardised_rate",
    "pr11_any_of_ten_flags",
    "pr17_percentage_shares",
    "rs1_pivot_by_code",
    "jn7_point_in_polygon",
    "cv3_park_share",
    "cv4_raster_zonal_mean",
    "sp1_contiguity",
    "sp10_space_time_precision",
    "pn2_median_imputation",
    "wn2_expected_counts",
    "dg5_ks_normality_by_year",
    "ps9_effect_bands",
    "md7_information_criteria",
    "cv9_final_covariate_join",
    "md3_area_effect",
    "md4_varying_slope",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # start-up and first compilation are not timed
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
