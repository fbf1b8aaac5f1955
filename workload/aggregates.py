"""Rollups, metrics, level of detail, alerts and column helpers."""

from pyspark.sql import functions as F

from tidemark.operators import metrics as m
from tidemark.operators.filters import Filter
from tidemark.operators.measures import Measure, aggregate

from .registry import query


def _geo(t):
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


@query("hierarchy_rollup", [92], """
    select year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as mo, count(*) as n, round(sum(o_totalprice), 2) as total,
      (3 - grouping(year(o_orderdate)) - grouping(quarter(o_orderdate)) - grouping(month(o_orderdate)))::int as level
    from orders group by rollup (year(o_orderdate), quarter(o_orderdate), month(o_orderdate))""".replace("year(o_orderdate)", "y").replace("quarter(o_orderdate)", "q").replace("month(o_orderdate)", "mo")
       .replace("from orders", "from (select *, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, month(o_orderdate)::int as mo from orders)"))
def hierarchy_rollup(t):
    df = t.orders.select("o_totalprice", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"),
                         F.month("o_orderdate").alias("mo"))
    return (m.hierarchy_rollup(df, ["y", "q", "mo"], [Measure("n", "count"), Measure("total", "sum", "o_totalprice")])
            .withColumn("total", F.round("total", 2)))


@query("having_filter", [93], """
    select o_custkey, count(*) as n, round(avg(o_totalprice), 6) as average from orders group by 1
    having count(*) > 12 and avg(o_totalprice) > 200000""")
def having_filter(t):
    from tidemark.plans.shapes import aggregation_query

    return aggregation_query(t.orders, ["o_custkey"], [Measure("n", "count"), Measure("average", "avg", "o_totalprice")],
                             having=[Filter("n", ">", 12), Filter("average", ">", 200000)]).withColumn("average", F.round("average", 6))


@query("pivot_with_subtotals", [94], """
    select o_orderpriority, grouping(o_orderpriority)::int as is_total,
      round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as "o_orderstatus_F", round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as "o_orderstatus_O",
      round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as "o_orderstatus_P", round(sum(o_totalprice), 2) as total
    from orders group by rollup (o_orderpriority)""")
def pivot_with_subtotals(t):
    out = m.pivot_with_subtotals(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"], Measure("v", "sum", "o_totalprice"))
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c not in ("o_orderpriority", "is_total")})


@query("ratio_derived_metrics", [95], """
    select l_suppkey, round(sum(l_extendedprice * (1 - l_discount)) / nullif(count(distinct l_orderkey), 0), 3) as revenue_per_order,
      round(100.0 * sum(case when l_returnflag = 'R' then l_quantity end) / nullif(sum(l_quantity), 0), 8) as return_pct
    from lineitem group by 1""")
def ratio_derived_metrics(t):
    out = m.metric_query(t.lineitem, ["l_suppkey"], [
        Measure("revenue", "sum", "l_extendedprice * (1 - l_discount)"), Measure("orders", "count_distinct", "l_orderkey"),
        Measure("qty", "sum", "l_quantity"), Measure("returned", "sum", "l_quantity", filters=(Filter("l_returnflag", "=", "R"),)),
    ], {"revenue_per_order": "try_divide(revenue, orders)", "return_pct": "try_divide(100.0D * returned, qty)"})
    return out.withColumns({"revenue_per_order": F.round("revenue_per_order", 3), "return_pct": F.round("return_pct", 8)})


@query("cumulative_metric_trailing", [96], """
    with d as (select event_type, ts::date as time_period, sum(round(value * 100)::bigint)::bigint as period_value from events group by 1, 2)
    select *, sum(period_value) over (partition by event_type order by time_period range between interval 6 days preceding and current row)::bigint as cumulative from d""")
def cumulative_metric_trailing(t):
    return m.cumulative_metric(t.events, "ts", "day", "cast(round(value * 100) as bigint)", ["event_type"], 7)


@query("cumulative_metric_unbounded", [96], """
    with d as (select date_trunc('month', o_orderdate)::date as time_period, sum(round(o_totalprice * 100)::bigint)::bigint as period_value from orders group by 1)
    select *, sum(period_value) over (order by time_period)::bigint as cumulative from d""")
def cumulative_metric_unbounded(t):
    return m.cumulative_metric(t.orders, "o_orderdate", "month", "cast(round(o_totalprice * 100) as bigint)")


@query("conversion_metric", [97], """
    with b as (select user_id, ts, exists (select 1 from events c where c.user_id = e.user_id and c.event_type = 'purchase'
        and c.ts >= e.ts and c.ts <= e.ts + interval 12 hour) as ok from events e where event_type = 'click')
    select count(*) as base_events, count(*) filter (ok) as converted_events, count(distinct user_id) as base_users,
      count(distinct case when ok then user_id end) as converted_users, count(*) filter (ok) / count(*) as conversion_rate from b""")
def conversion_metric(t):
    return m.conversion_metric(t.events, "user_id", "ts", "event_type", "click", "purchase", 12 * 3600)


@query("lod_fixed", [98], """
    with f as (select o_custkey, round(sum(o_totalprice), 2) as customer_total from orders group by 1)
    select o_orderkey, o.o_custkey, customer_total from orders o join f on o.o_custkey = f.o_custkey where o_orderdate >= timestamp '2001-01-01'""")
def lod_fixed(t):
    recent = t.orders.filter("o_orderdate >= timestamp_ntz '2001-01-01'").select("o_orderkey", "o_custkey")
    return (m.lod_fixed(recent, t.orders, ["o_custkey"], Measure("customer_total", "sum", "o_totalprice"))
            .withColumn("customer_total", F.round("customer_total", 2)))


@query("lod_include", [99], """
    select o_orderpriority, round(avg(n), 8) as avg_orders_per_customer from
    (select o_orderpriority, o_custkey, count(*) as n from orders group by 1, 2) group by 1""")
def lod_include(t):
    return (m.lod_include(t.orders, ["o_orderpriority"], ["o_custkey"], Measure("n", "count"),
                          Measure("avg_orders_per_customer", "avg", "n"))
            .withColumn("avg_orders_per_customer", F.round("avg_orders_per_customer", 8)))


@query("lod_exclude", [100], """
    select r_name, n_name, count(*) as customers, sum(count(*)) over (partition by r_name)::bigint as region_customers
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def lod_exclude(t):
    return m.lod_exclude(_geo(t), ["r_name", "n_name"], ["n_name"], Measure("customers", "count"), "region_customers")


@query("aggregate_projection_daily", [101], """
    select ts::date as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2""")
def aggregate_projection_daily(t):
    from tidemark.sources.writers import write_replace
    from tidemark.session import work_path

    rolled = m.daily_rollup(t.events, "ts", ["event_type"], [Measure("n", "count"), Measure("total", "sum", "value")])
    path = work_path(t.spark, "daily")
    write_replace(rolled, path)
    return t.spark.read.parquet(path).withColumn("total", F.round("total", 2))


@query("kpi_alert", [102], """
    with d as (select ts::date as time_period, count(*) as n, round(sum(value), 2) as total from events group by 1),
    c as (select *, round((n - lag(n) over (order by time_period)) * 100.0 / lag(n) over (order by time_period), 6) as n_change from d)
    select time_period, n, n_change from c where n > 330 and n_change >= 1.5""")
def kpi_alert(t):
    return (m.kpi_alert(t.events, "ts", "day", [Measure("n", "count")], [("n", ">", 330), ("n_change", ">=", 1.5)])
            .withColumn("n_change", F.round("n_change", 6)))


@query("kpi_alert_any", [48, 102], """
    with d as (select ts::date as time_period, event_type, count(*) as n from events group by 1, 2),
    c as (select *, (n - lag(n) over w) * 100.0 / lag(n) over w as chg from d window w as (partition by event_type order by time_period))
    select time_period, event_type, n from c where n < 45 or n > 90 or chg < -30""")
def kpi_alert_any(t):
    return (m.kpi_alert(t.events, "ts", "day", [Measure("n", "count")],
                        [("n", "outside", (45, 90)), ("n_change", "<", -30)], "or", ["event_type"])
            .select("time_period", "event_type", "n"))


@query("column_values", [103], """
    select p_brand, count(*) as n from part where p_type = 'PROMO' group by 1 order by n desc, p_brand limit 5""")
def column_values(t):
    return m.column_values(t.part, "p_brand", 5, "p_type = 'PROMO'")


@query("results_as_dict", [104], """
    select o_orderpriority, o_orderstatus, count(*) as n, round(count(*) / (select count(*) from orders x where x.o_orderstatus = o.o_orderstatus), 9) as share from orders o group by 1, 2""")
def results_as_dict(t):
    totals = m.results_as_dict(t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    of_status = F.create_map(*[F.lit(x) for pair in zip(totals["o_orderstatus"], totals["n"]) for x in pair])
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.element_at(of_status, F.col("o_orderstatus")), 9))


@query("single_value", [104], """
    select o_orderstatus, count(*) as n, (select max(o_totalprice) from orders) as top_price from orders group by 1""")
def single_value(t):
    top = m.single_value(t.orders.agg(F.max("o_totalprice")))
    counts = t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return counts.select("o_orderstatus", "n", F.lit(top).alias("top_price"))


@query("median_of_groups_without_values", [77, 78, 80, 82], """
    select o_custkey % 50 as g, round(median(o_totalprice) filter (o_custkey % 50 <> 7), 6) as middle,
      round(quantile_cont(o_totalprice, 0.9) filter (o_orderstatus = 'P' and o_custkey % 50 <> 7), 6) as high_pending from orders group by 1""")
def median_of_groups_without_values(t):
    df = t.orders.withColumn("g", F.expr("o_custkey % 50")).withColumn("price", F.expr("case when g <> 7 then o_totalprice end"))
    out = aggregate(df, ["g"], [Measure("middle", "median", "price"),
                                Measure("high_pending", "percentile", "price", 90, (Filter("o_orderstatus", "=", "P"),))])
    return out.withColumns({c: F.round(c, 6) for c in ("middle", "high_pending")})


@query("hierarchy_rollup_median", [92, 77], """
    select y, q, count(*) as n, round(median(o_totalprice), 6) as middle, (2 - grouping(y) - grouping(q))::int as level
    from (select *, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q from orders) group by rollup (y, q)""")
def hierarchy_rollup_median(t):
    df = t.orders.select("o_totalprice", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    return (m.hierarchy_rollup(df, ["y", "q"], [Measure("n", "count"), Measure("middle", "median", "o_totalprice")])
            .withColumn("middle", F.round("middle", 6)))


@query("pivot_with_subtotals_median", [94, 77], """
    select o_orderpriority, grouping(o_orderpriority)::int as is_total,
      round(median(o_totalprice) filter (o_orderstatus = 'F'), 6) as "o_orderstatus_F",
      round(median(o_totalprice) filter (o_orderstatus = 'P'), 6) as "o_orderstatus_P", round(median(o_totalprice), 6) as total
    from orders group by rollup (o_orderpriority)""")
def pivot_with_subtotals_median(t):
    out = m.pivot_with_subtotals(t.orders, "o_orderpriority", "o_orderstatus", ["F", "P"], Measure("v", "median", "o_totalprice"))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c not in ("o_orderpriority", "is_total")})
