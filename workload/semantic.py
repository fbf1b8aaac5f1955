"""Semantic queries, typed query shapes and measures."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators.filters import Filter
from tidemark.operators.measures import Measure, aggregate, count_where, sum_where
from tidemark.plans import shapes
from tidemark.plans.semantic import (Dimension, Relationship, SemanticLayer, SemanticModel, SemanticQuery, page,
                                     semantic_query)

from .registry import Tables, query

REVENUE = "l_extendedprice * (1 - l_discount)"


def layer(t: Tables) -> SemanticLayer:
    return SemanticLayer(
        models=[
            SemanticModel("sales", lambda: t.lineitem, measures=[
                Measure("revenue", "sum", REVENUE), Measure("quantity", "sum", "l_quantity"),
                Measure("order_count", "count_distinct", "l_orderkey"),
                Measure("median_price", "median", "l_extendedprice"),
                Measure("returned_quantity", "sum", "l_quantity", filters=(Filter("l_returnflag", "=", "R"),)),
            ], dimensions=[Dimension("return_flag", "l_returnflag"),
                           Dimension("ship_date", "l_shipdate", "temporal")]),
            SemanticModel("orders", lambda: t.orders, measures=[
                Measure("order_value", "sum", "o_totalprice"), Measure("placed_orders", "count", "o_orderkey")], dimensions=[
                Dimension("order_date", "o_orderdate", "temporal"),
                Dimension("order_month", "trunc(o_orderdate, 'month')", "hierarchical", "calendar", 3, "order_quarter"),
                Dimension("order_year", "year(o_orderdate)", "hierarchical", "calendar", 1),
                Dimension("priority", "o_orderpriority"), Dimension("status", "o_orderstatus")]),
            SemanticModel("customers", lambda: t.customer, kind="dimension", dimensions=[
                Dimension("segment", "c_mktsegment")]),
            SemanticModel("nations", lambda: t.nation, kind="dimension", dimensions=[Dimension("nation", "n_name")]),
            SemanticModel("regions", lambda: t.region, kind="dimension", dimensions=[Dimension("region", "r_name")]),
        ],
        relationships=[
            Relationship("sales", "orders", "l_orderkey", "o_orderkey", "inner"),
            Relationship("orders", "customers", "o_custkey", "c_custkey", "inner"),
            Relationship("customers", "nations", "c_nationkey", "n_nationkey", "inner"),
            Relationship("nations", "regions", "n_regionkey", "r_regionkey", "inner"),
        ])


@query("semantic_revenue_by_region_month", [37, 38, 39, 41, 61, 63, 75, 76, 84], """
    select r_name as region, date_trunc('month', o_orderdate)::date as order_month,
           round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue,
           count(distinct l_orderkey) as order_count
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where c_mktsegment = 'BUILDING' group by 1, 2""")
def semantic_revenue_by_region_month(t):
    q = SemanticQuery(["revenue", "order_count"], ["region", "order_month"], {"segment": "BUILDING"})
    return semantic_query(layer(t), q).withColumn("revenue", F.round("revenue", 4))


@query("semantic_pre_aggregated", [63, 84], """
    select r_name as region, date_trunc('month', o_orderdate)::date as order_month, l_returnflag as return_flag,
           round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, count(distinct l_orderkey) as order_count,
           sum(l_quantity) filter (l_returnflag = 'R') as returned_quantity
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where o_orderstatus = 'F' and l_shipdate >= timestamp '1996-01-01' and l_shipdate <= timestamp '1999-06-30' group by 1, 2, 3""")
def semantic_pre_aggregated(t):
    q = SemanticQuery(["revenue", "order_count", "returned_quantity"], ["region", "order_month", "return_flag"], {"status": "F"},
                      time_dimension="ship_date", date_from="1996-01-01", date_to="1999-06-30", pre_aggregate=True)
    return semantic_query(layer(t), q).withColumn("revenue", F.round("revenue", 4))


@query("semantic_query_paged", [84, 93, 114, 115, 51], """
    select n_name as nation, l_returnflag as return_flag, sum(l_quantity) as quantity
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey
    where o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1998-12-31'
      and o_orderpriority in ('1-URGENT', '2-HIGH')
    group by 1, 2 having sum(l_quantity) > 10
    order by quantity desc, nation, return_flag limit 20 offset 5""")
def semantic_query_paged(t):
    return semantic_query(layer(t), SemanticQuery(
        ["quantity"], ["nation", "return_flag"], {"priority": ["1-URGENT", "2-HIGH"]},
        having=[Filter("quantity", ">", 10)], time_dimension="order_date", date_from="1996-01-01",
        date_to="1998-12-31", order_by=["-quantity", "nation", "return_flag"], limit=20, offset=5))


@query("semantic_filtered_and_median", [82, 77, 84], """
    select o_orderpriority as priority, sum(l_quantity) filter (l_returnflag = 'R') as returned_quantity,
           round(median(l_extendedprice), 4) as median_price
    from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def semantic_filtered_and_median(t):
    return (semantic_query(layer(t), SemanticQuery(["returned_quantity", "median_price"], ["priority"]))
            .withColumn("median_price", F.round("median_price", 4)))


@query("semantic_two_facts", [65, 84], """
    with s as (select o_orderpriority as priority, sum(l_quantity) as quantity from lineitem join orders on l_orderkey = o_orderkey
        where o_orderstatus = 'F' group by 1),
    o as (select o_orderpriority as priority, round(sum(o_totalprice), 2) as order_value, count(*) as placed_orders from orders where o_orderstatus = 'F' group by 1)
    select coalesce(s.priority, o.priority) as priority, quantity, order_value, placed_orders from s full join o on s.priority = o.priority""")
def semantic_two_facts(t):
    return (semantic_query(layer(t), SemanticQuery(["quantity", "order_value", "placed_orders"], ["priority"], {"status": "F"}))
            .withColumn("order_value", F.round("order_value", 2)))


@query("agg_basic", [75], """
    select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, count(l_orderkey) as n,
           round(avg(l_extendedprice), 6) as avg_price, min(l_shipdate)::date as first_ship, max(l_discount) as max_disc
    from lineitem group by 1, 2""")
def agg_basic(t):
    out = aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], [
        Measure("sum_qty", "sum", "l_quantity"), Measure("n", "count", "l_orderkey"),
        Measure("avg_price", "avg", "l_extendedprice"), Measure("first_ship", "min", "cast(l_shipdate as date)"),
        Measure("max_disc", "max", "l_discount")])
    return out.withColumn("avg_price", F.round("avg_price", 6))


@query("agg_count_distinct", [76], """
    select event_type, count(distinct user_id) as users, count(distinct props) as payloads from events group by 1""")
def agg_count_distinct(t):
    return aggregate(t.events, ["event_type"], [Measure("users", "count_distinct", "user_id"),
                                                Measure("payloads", "count_distinct", "props")])


@query("agg_median", [77], """
    select c_mktsegment, round(median(c_acctbal), 4) as median_balance from customer group by 1""")
def agg_median(t):
    return (aggregate(t.customer, ["c_mktsegment"], [Measure("median_balance", "median", "c_acctbal")])
            .withColumn("median_balance", F.round("median_balance", 4)))


@query("agg_percentile", [78], """
    select l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) as p90,
           round(quantile_cont(l_extendedprice, 0.25), 4) as p25
    from lineitem group by 1""")
def agg_percentile(t):
    out = aggregate(t.lineitem, ["l_returnflag"], [Measure("p90", "percentile", "l_extendedprice", 90),
                                                   Measure("p25", "percentile", "l_extendedprice", 25)])
    return out.withColumns({c: F.round(c, 4) for c in ("p90", "p25")})


@query("agg_percentile_cont_disc", [80], """
    select o_orderpriority, round(quantile_cont(o_totalprice, 0.75), 4) as p75_cont,
           quantile_disc(o_totalprice, 0.75) as p75_disc from orders group by 1""")
def agg_percentile_cont_disc(t):
    out = aggregate(t.orders, ["o_orderpriority"], [
        Measure("p75_cont", "percentile", "o_totalprice", 75),
        Measure("p75_disc", "percentile_disc", "o_totalprice", 75)])
    return out.withColumn("p75_cont", F.round("p75_cont", 4))


@query("agg_stddev_variance", [79], """
    select p_brand, round(stddev_pop(p_retailprice), 6) as sd, round(var_pop(p_size), 6) as vr from part group by 1""")
def agg_stddev_variance(t):
    out = aggregate(t.part, ["p_brand"], [Measure("sd", "stddev", "p_retailprice"), Measure("vr", "variance", "p_size")])
    return out.withColumns({c: F.round(c, 6) for c in ("sd", "vr")})


@query("agg_stddev_var_samp", [81], """
    select event_type, round(stddev_samp(value), 6) as sd, round(var_samp(value), 5) as vr from events group by 1""")
def agg_stddev_var_samp(t):
    out = aggregate(t.events, ["event_type"], [Measure("sd", "stddev_samp", "value"), Measure("vr", "var_samp", "value")])
    return out.withColumns({"sd": F.round("sd", 6), "vr": F.round("vr", 5)})


@query("filtered_measure", [82], """
    select n_regionkey, round(sum(s_acctbal) filter (s_acctbal > 0 and n_name like 'NATION_1%'), 2) as positive_balance,
           count(s_suppkey) as suppliers from supplier join nation on s_nationkey = n_nationkey group by 1""")
def filtered_measure(t):
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    out = aggregate(joined, ["n_regionkey"], [
        Measure("positive_balance", "sum", "s_acctbal",
                filters=(Filter("s_acctbal", ">", 0), Filter("n_name", "like", "NATION_1%"))),
        Measure("suppliers", "count", "s_suppkey")])
    return out.withColumn("positive_balance", F.round("positive_balance", 2))


@query("conditional_aggregation", [83], """
    select o_custkey, count(case when o_orderstatus = 'F' then 1 end) as finished,
           round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as open_value from orders group by 1""")
def conditional_aggregation(t):
    return t.orders.groupBy("o_custkey").agg(
        count_where("o_orderstatus = 'F'").alias("finished"),
        F.round(sum_where("o_orderstatus = 'O'", "o_totalprice"), 2).alias("open_value"))


@query("aggregation_query", [85, 89], """
    select p_brand, count(*) as parts, max(p_size) as biggest from part where p_type in ('ECONOMY', 'PROMO')
    group by 1 having count(*) >= 3 order by parts desc, p_brand limit 10""")
def aggregation_query(t):
    return shapes.aggregation_query(t.part, ["p_brand"], [Measure("parts", "count"), Measure("biggest", "max", "p_size")],
                                    [Filter("p_type", "IN", ["ECONOMY", "PROMO"])], [Filter("parts", ">=", 3)],
                                    ["-parts", "p_brand"], 10)


@query("comparison_query", [86], """
    select o_orderpriority,
           round(sum(case when o_orderstatus = 'F' then o_totalprice end), 2) as value_F,
           round(sum(case when o_orderstatus = 'O' then o_totalprice end), 2) as value_O,
           round(sum(o_totalprice), 2) as value_total
    from orders where o_orderstatus in ('F', 'O') group by 1""")
def comparison_query(t):
    out = shapes.comparison_query(t.orders, "o_orderstatus", ["F", "O"], [Measure("value", "sum", "o_totalprice")],
                                  ["o_orderpriority"])
    return out.withColumns({c: F.round(c, 2) for c in out.columns if c.startswith("value_")})


@query("trend_query_month", [87], """
    select date_trunc('month', o_orderdate)::date as time_period, o_orderstatus, round(sum(o_totalprice), 2) as total
    from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate <= timestamp '1997-12-31' group by 1, 2""")
def trend_query_month(t):
    return (shapes.trend_query(t.orders, "o_orderdate", "month", [Measure("total", "sum", "o_totalprice")],
                               ["o_orderstatus"], (), "1997-01-01", "1997-12-31")
            .withColumn("total", F.round("total", 2)))


@query("trend_query_week", [87, 152], """
    select (ts::date - extract(dow from ts)::int)::date as time_period, count(*) as n from events group by 1""")
def trend_query_week(t):
    return shapes.trend_query(t.events, "ts", "week", [Measure("n", "count")])


@query("trend_query_hour", [87], """
    select date_trunc('hour', ts) as time_period, event_type, count(*) as n, round(max(value), 2) as top
    from events group by 1, 2""")
def trend_query_hour(t):
    return (shapes.trend_query(t.events, "ts", "hour", [Measure("n", "count"), Measure("top", "max", "value")],
                               ["event_type"]).withColumn("top", F.round("top", 2)))


@query("trend_query_grains", [87], """
    select 'day' as grain, o_orderdate::date as time_period, count(*) as n from orders group by all
    union all select 'quarter', date_trunc('quarter', o_orderdate)::date, count(*) from orders group by all
    union all select 'year', date_trunc('year', o_orderdate)::date, count(*) from orders group by all""")
def trend_query_grains(t):
    parts = [shapes.trend_query(t.orders, "o_orderdate", g, [Measure("n", "count")]).withColumn("grain", F.lit(g))
             for g in ("day", "quarter", "year")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("top_n_query", [88], """
    select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by 1 order by spent desc, o_custkey limit 25""")
def top_n_query(t):
    return (shapes.top_n_query(t.orders, "o_custkey", Measure("spent", "sum", "o_totalprice"), 25)
            .withColumn("spent", F.round("spent", 2)))


@query("bottom_n_query", [88], """
    select l_suppkey, sum(l_quantity) as qty from lineitem group by 1 order by qty, l_suppkey limit 7""")
def bottom_n_query(t):
    return shapes.top_n_query(t.lineitem, "l_suppkey", Measure("qty", "sum", "l_quantity"), 7, ascending=True)


@query("filter_and_drill_down", [89, 92], """
    select r_name, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1, 2""")
def filter_and_drill_down(t):
    df = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
          .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))
    return shapes.drill_down(df, ["r_name", "n_name", "c_mktsegment"], {"r_name": "ASIA"}, [Measure("customers", "count")])


@query("distribution_query", [90, 240], """
    with b as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
    select least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19)::bigint + 1 as bin, count(*) as n
    from orders, b group by 1""")
def distribution_query(t):
    return shapes.distribution_query(t.orders, "o_totalprice", 20).select("bin", "n")


@query("correlation_query", [91], """
    select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 8) as correlation,
           round(regr_slope(l_extendedprice, l_quantity), 5) as slope,
           round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept from lineitem group by 1""")
def correlation_query(t):
    return (shapes.correlation_query(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
            .withColumns({"correlation": F.round("correlation", 8), "slope": F.round("slope", 5),
                          "intercept": F.round("intercept", 4)}))


@query("order_by_limit_offset", [114, 115], """
    select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 15 offset 30""")
def order_by_limit_offset(t):
    return page(t.customer.select("c_custkey", "c_acctbal"), ["-c_acctbal", "c_custkey"], 15, 30)


@query("semantic_measure_over_to_many", [63, 84], """
    select l_returnflag as return_flag, priority, round(sum(o_totalprice), 2) as order_value, count(*) as placed_orders
    from (select distinct o_orderkey, o_totalprice, o_orderpriority as priority, l_returnflag from orders join lineitem on o_orderkey = l_orderkey) group by 1, 2""")
def semantic_measure_over_to_many(t):
    # an order counts once for each flag among its lines, whatever their number
    q = SemanticQuery(["order_value", "placed_orders"], ["return_flag", "priority"])
    return semantic_query(layer(t), q).withColumn("order_value", F.round("order_value", 2))


@query("semantic_measure_over_conditional_to_many", [63, 84], """
    select l_returnflag as return_flag, priority, round(sum(o_totalprice), 2) as order_value, count(*) as placed_orders
    from (select distinct o_orderkey, o_totalprice, o_orderpriority as priority, l_returnflag from orders
          join lineitem on o_orderkey = l_orderkey and l_extendedprice > o_totalprice / 4) group by 1, 2""")
def semantic_measure_over_conditional_to_many(t):
    # only lines that make a quarter of their order put it into a flag's group, and once
    plain = layer(t)
    edges = [replace(e, condition="l_extendedprice > o_totalprice / 4") if e.left == "sales" else e for e in plain.relationships]
    q = SemanticQuery(["order_value", "placed_orders"], ["return_flag", "priority"])
    return semantic_query(SemanticLayer(plain.models, edges), q).withColumn("order_value", F.round("order_value", 2))
