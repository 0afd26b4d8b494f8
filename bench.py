"""Headline timings; prints one JSON line.

Each query is run once to warm up; the faster of the next two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from samplewright.operators import comparison, precision, survey
from samplewright.operators.bootstrap import bootstrap_groups, bootstrap_two
from samplewright.plans.studies import coverage_curve, resample_with_ci
from samplewright.session import build_session
from samplewright.sources.files import stage

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
G, V, UNIT = "c_nationkey", "c_acctbal", "c_custkey"


def main() -> None:
    spark = build_session(f"local[{CPUS}]", shuffle_partitions=int(CPUS), spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")

    def table(name: str):
        return spark.read.parquet(f"{SF_DIR}/{name}.parquet")

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    customers = table("customer").select(UNIT, G, V, "c_mktsegment")
    parts = table("part").select("p_type", F.expr("nullif(p_size, 7)").alias("n"))
    cells = customers.withColumn("cell", F.concat_ws("/", G, "c_mktsegment"))
    orders = table("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    staged = stage(resample_with_ci(customers, G, V, UNIT))
    queries = {
        # 25 groups x 48 sizes x 499 iterations
        "bootstrap_25_groups": lambda: run(bootstrap_groups(customers, G, V, UNIT)),
        # 125 groups, 2,994,000 resamples
        "bootstrap_125_groups": lambda: run(bootstrap_groups(cells, "cell", V, UNIT)),
        # 3 groups of about 50,000 rows, which are joined to their draws
        "bootstrap_large_groups": lambda: run(bootstrap_groups(orders, "o_orderstatus", "o_totalprice", "o_orderkey")),
        "resample_with_ci_staged": lambda: stage(resample_with_ci(customers, G, V, UNIT)),
        "coverage_curve_end_to_end": lambda: run(coverage_curve(resample_with_ci(customers, G, V, UNIT), G)),
        "coverage_curve_from_staged": lambda: run(coverage_curve(staged, G)),
        "precision_change_from_staged": lambda: run(precision.pooled_change(staged, G, with_sd=True)),
        "precision_width_from_staged": lambda: run(precision.pooled_width_rel(staged, G)),
        "two_group_curve": lambda: run(
            comparison.two_group_curve(
                bootstrap_two(customers, "c_mktsegment", "HOUSEHOLD", "MACHINERY", V, UNIT), 15
            )
        ),
        "welch_and_design": lambda: run(
            comparison.design_analysis(comparison.pooled_se(customers, "c_mktsegment", V, [("HOUSEHOLD", "MACHINERY")]), [50.0, 250.0])
        ),
        "survey_distribution": lambda: run(survey.distribution_summary(parts, "n", "p_type")),
        "survey_histogram": lambda: run(survey.histogram(parts, "n", by="p_type")),
    }
    seconds = {}
    for name, query in queries.items():
        query()
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            query()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
