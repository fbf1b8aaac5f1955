"""Time the headline queries: one untimed run, then the median of the timed ones, in seconds.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the data, the cores and the runs;
`--all` times every registered query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemark.session import build_session, release_work
from workload import registry

HEADLINE = """
semantic_revenue_by_region_month semantic_pre_aggregated semantic_query_paged agg_basic agg_count_distinct agg_percentile comparison_query
trend_query_month trend_query_week top_n_query distribution_query correlation_query relative_period_filter
inner_join_theta salted_join many_to_many_join drill_across range_lookup interval_join lineage_downstream
window_rankings running_total moving_average_running_count percent_of_total period_growth deduplicate latest_version
hierarchy_rollup pivot_with_subtotals cumulative_metric_trailing conversion_metric lod_fixed pivot unpivot surrogate_key
url_parts json_property date_dimension fiscal_sales merge_upsert scd2_merge merge_partitions incremental_merge partitioned_write
test_unique test_relationships test_within_n_moving_stdevs test_mutually_exclusive_ranges run_quality_suite
box_plot_stats flow_links word_counts incremental_rollup stream_dedupe
lookup_orders lookup_recent_orders lookup_customers_by_status lookup_products_by_category lookup_customer_names
join_top_customers join_product_revenue join_customer_baskets group_orders_by_month group_orders_by_month_region
group_orders_by_week_hour group_products_by_category group_customers_by_region_status
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry.load_all()
    spark = build_session("bench", cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    names = list(registry.QUERIES) if "--all" in sys.argv else HEADLINE
    timings = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            release_work(spark)
        timings[name] = round(statistics.median(taken[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
