"""Chart shapes."""

from pyspark.sql import functions as F

from tidemark.operators import charts as c
from tidemark.operators.measures import Measure

from .registry import query

_BOX = """q as (select l_suppkey, quantile_cont(l_extendedprice, 0.25) as q1, median(l_extendedprice) as med, quantile_cont(l_extendedprice, 0.75) as q3 from x group by 1),
    f as (select x.*, q1, med, q3, l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as ok from x join q using (l_suppkey))"""


@query("box_plot_stats", [233], f"""
    with x as (select l_suppkey, l_extendedprice from lineitem), {_BOX}
    select l_suppkey, min(l_extendedprice) filter (ok) as whisker_low, round(max(q1), 4) as q1, round(max(med), 4) as median, round(max(q3), 4) as q3,
      max(l_extendedprice) filter (ok) as whisker_high, count(*) filter (not ok) as outliers from f group by 1""")
def box_plot_stats(t):
    out = c.box_plot_stats(t.lineitem, ["l_suppkey"], "l_extendedprice")
    return out.withColumns({k: F.round(k, 4) for k in ("q1", "median", "q3")})


@query("box_plot_outliers", [233], f"""
    with x as (select event_type as l_suppkey, value as l_extendedprice from events), {_BOX}
    select l_suppkey as event_type, l_extendedprice as value, count(*) as n from f where not ok group by 1, 2""")
def box_plot_outliers(t):
    return c.box_plot_outliers(t.events, ["event_type"], "value")


@query("hierarchy_tree", [234], """
    with x as (select r_name, coalesce(nullif(n_name, 'NATION_7'), '∅') as n_name, c_mktsegment, c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
    select r_name as path, 1 as depth, round(sum(c_acctbal), 2) as value from x group by 1 union all select r_name || ' / ' || n_name, 2, round(sum(c_acctbal), 2) from x group by 1
    union all select r_name || ' / ' || n_name || ' / ' || c_mktsegment, 3, round(sum(c_acctbal), 2) from x group by 1""")
def hierarchy_tree(t):
    df = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
          .withColumn("n_name", F.expr("nullif(n_name, 'NATION_7')")))
    return c.hierarchy_tree(df, ["r_name", "n_name", "c_mktsegment"], "c_acctbal").withColumn("value", F.round("value", 2))


@query("flow_links", [235], """
    select cn.n_name as source, sn.n_name as target, sum(l_quantity) as value from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation cn on c_nationkey = cn.n_nationkey join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey group by 1, 2 having sum(l_quantity) > 0""")
def flow_links(t):
    buyers = t.customer.join(t.nation.select("n_nationkey", F.col("n_name").alias("buyer")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "buyer")
    sellers = t.supplier.join(t.nation.select("n_nationkey", F.col("n_name").alias("seller")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "seller")
    df = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
          .join(sellers, F.col("l_suppkey") == F.col("s_suppkey")))
    return c.flow_links(df, "buyer", "seller", "l_quantity")


@query("heatmap_matrix", [236], """
    with x as (select distinct o_custkey from orders), y as (select distinct o_orderpriority from orders),
    v as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2)
    select x.o_custkey, y.o_orderpriority, coalesce(n, 0) as n from x cross join y left join v on v.o_custkey = x.o_custkey and v.o_orderpriority = y.o_orderpriority""")
def heatmap_matrix(t):
    return c.heatmap_matrix(t.orders, "o_custkey", "o_orderpriority", Measure("n", "count"))


@query("funnel_steps", [237], """
    with s as (select * from (values (1, 'view'), (2, 'click'), (3, 'signup'), (4, 'purchase')) v(step, event_type)),
    n as (select step, event_type, count(distinct user_id) as users from events join s using (event_type) group by 1, 2)
    select step, event_type, users, users / lag(users) over (order by step) as step_conversion, users / first_value(users) over (order by step) as overall_conversion from n""")
def funnel_steps(t):
    return c.funnel_steps(t.events, "event_type", ["view", "click", "signup", "purchase"], Measure("users", "count_distinct", "user_id"))


@query("kpi_value", [238], """
    with k as (select round(sum(o_totalprice) filter (o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01'), 2) as value,
      round(sum(o_totalprice) filter (o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'), 2) as previous from orders)
    select value, previous, round(value - previous, 2) as change, round((value - previous) * 100 / previous, 6) as percent_change, round(value / 1e9, 8) as of_target from k""")
def kpi_value(t):
    out = c.kpi_value(t.orders, "o_orderdate", F.col("o_totalprice"), ("1998-01-01", "1999-01-01"), ("1997-01-01", "1998-01-01"), 1e9)
    return out.withColumns({"value": F.round("value", 2), "previous": F.round("previous", 2), "change": F.round("change", 2),
                            "percent_change": F.round("percent_change", 6), "of_target": F.round("of_target", 8)})


@query("gauge_zone", [239], """
    with r as (select l_suppkey, 100.0 * count(*) filter (l_returnflag = 'R') / count(*) as rate from lineitem group by 1)
    select l_suppkey, round(rate, 8) as rate, case when rate < 32 then 'green' when rate < 34 then 'yellow' else 'red' end as zone from r""")
def gauge_zone(t):
    rate = t.lineitem.groupBy("l_suppkey").agg((100.0 * F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("rate"))
    return c.gauge_zone(rate, "rate", c.zones_of({"green": 32, "yellow": 34}), "red").withColumn("rate", F.round("rate", 8))


@query("histogram_bins", [240], """
    with b as (select min(value) as lo, (max(value) - min(value)) / 12 as w from events)
    select event_type, least(floor((value - lo) / w), 11)::bigint + 1 as bin, round(min(lo) + (least(floor((value - lo) / w), 11)) * min(w), 6) as bin_start, count(*) as n
    from events, b group by event_type, least(floor((value - lo) / w), 11)""")
def histogram_bins(t):
    return (c.histogram_bins(t.events, "value", 12, ["event_type"]).drop("bin_end").withColumn("bin_start", F.round("bin_start", 6)))


@query("word_counts", [241], r"""
    select lang, word, count(*) as n from (select lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) as word from documents) where word <> '' group by 1, 2""")
def word_counts(t):
    return c.word_counts(t.documents, "text", ["lang"])


@query("paired_t_test", [242], """
    with d as (select l_suppkey, l_tax - l_discount as d from lineitem)
    select l_suppkey, count(d) as n, round(avg(d), 9) as mean_difference, round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) as t, count(d) - 1 as df from d group by 1""")
def paired_t_test(t):
    return (c.paired_t_test(t.lineitem, "l_tax", "l_discount", ["l_suppkey"])
            .withColumns({"mean_difference": F.round("mean_difference", 9), "t": F.round("t", 6)}))


@query("waterfall", [243], """
    with m as (select date_trunc('month', ts)::date as m, ts::date as day, sum(case when event_type = 'purchase' then 1 when event_type = 'error' then -1 else 0 end)::bigint as net from events group by 1, 2),
    r as (select day, net, sum(net) over (order by day)::bigint as end_value from m) select day, net, end_value, end_value - net as start_value from r""")
def waterfall(t):
    net = Measure("net", "sum", "case when event_type = 'purchase' then 1 when event_type = 'error' then -1 else 0 end")
    return c.waterfall(t.events.withColumn("day", F.col("ts").cast("date")), "day", net)


@query("time_series_compare", [244, 72], """
    with m as (select o_orderstatus, date_trunc('quarter', o_orderdate)::date as time_period, count(*) as n from orders group by 1, 2)
    select a.o_orderstatus, a.time_period, a.n, b.n as prior_n, a.n - b.n as difference, round(a.n / b.n, 10) as ratio
    from m a left join m b on a.o_orderstatus = b.o_orderstatus and b.time_period = (a.time_period - interval 3 month)::date""")
def time_series_compare(t):
    return (c.time_series_compare(t.orders, "o_orderdate", "quarter", Measure("n", "count"), 3, ["o_orderstatus"])
            .withColumn("ratio", F.round("ratio", 10)))


@query("time_pivot", [244], """
    select date_trunc('year', o_orderdate)::date as time_period, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as "F",
      sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as "O" from orders group by 1""")
def time_pivot(t):
    return c.time_pivot(t.orders, "o_orderdate", "year", "o_orderstatus", ["F", "O"])


@query("time_table", [244], """
    with m as (select o_custkey, date_trunc('month', o_orderdate)::date as p, count(*) as n from orders group by 1, 2)
    select o_custkey, min(p) as first_period, max(p) as last_period, arg_min(n, p) as first_value, arg_max(n, p) as last_value, count(*) as periods,
      arg_max(n, p) - arg_min(n, p) as change from m group by 1""")
def time_table(t):
    return c.time_table(t.orders, "o_custkey", "o_orderdate", "month", Measure("n", "count"))


@query("calendar_heatmap", [245], """
    with x as (select o_orderdate::date as d from orders),
    s as (select unnest(generate_series((select min(d) from x), (select max(d) from x), interval 1 day))::date as day)
    select day, count(d) as n from s left join x on d = day group by 1""")
def calendar_heatmap(t):
    return c.calendar_heatmap(t.orders, "o_orderdate", Measure("n", "count"))


_XY = "((event_id * 37) % 1800) / 10.0 - 90 as lat, ((event_id * 91) % 3600) / 10.0 - 180 as lon"


def _points(t):
    return t.events.selectExpr("event_id", "value", "cast(((event_id * 37) % 1800) / 10.0D - 90 as double) as lat",
                               "cast(((event_id * 91) % 3600) / 10.0D - 180 as double) as lon")


@query("grid_bins", [246], f"""
    with p as (select value, {_XY} from events) select floor(lon / 10)::bigint as cell_x, floor(lat / 10)::bigint as cell_y, count(*) as n, max(value) as top from p group by 1, 2""")
def grid_bins(t):
    return c.grid_bins(_points(t), "lat", "lon", 10.0, [Measure("n", "count"), Measure("top", "max", "value")])


@query("hex_bins", [246], f"""
    with p as (select event_id, {_XY} from events), a as (select *, (lon * sqrt(3) / 3 - lat / 3) / 7.3 as q, lat * 2 / 3 / 7.3 as r from p),
    c as (select *, round(q) as cq, round(r) as cr from a),
    n as (select event_id, q, r, cq + dq as hq, cr + dr as hr from c, (select unnest([-1, 0, 1]) as dq), (select unnest([-1, 0, 1]) as dr)),
    best as (select event_id, arg_min(hq, (hq - q) * (hq - q) + (hq - q) * (hr - r) + (hr - r) * (hr - r)) as hex_q, arg_min(hr, (hq - q) * (hq - q) + (hq - q) * (hr - r) + (hr - r) * (hr - r)) as hex_r from n group by 1)
    select hex_q::bigint as hex_q, hex_r::bigint as hex_r, count(*) as n from best group by 1, 2""")
def hex_bins(t):
    return c.hex_bins(_points(t), "lat", "lon", 7.3, [Measure("n", "count")])


@query("point_clusters", [246], f"""
    with p as (select {_XY} from events) select floor(lon / 22.5)::bigint as cell_x, floor(lat / 22.5)::bigint as cell_y, count(*) as points, round(avg(lat), 8) as center_lat, round(avg(lon), 8) as center_lon from p group by 1, 2""")
def point_clusters(t):
    return c.point_clusters(_points(t), "lat", "lon", 4).withColumns({"center_lat": F.round("center_lat", 8), "center_lon": F.round("center_lon", 8)})


_SCALE = """with s as (select l_suppkey, sum(l_quantity) as qty, count(distinct l_partkey) as parts from lineitem group by 1),
    e as (select min(qty) as q0, max(qty) as q1, min(parts) as p0, max(parts) as p1 from s)"""


@query("parallel_coordinates", [247], f"""
    {_SCALE} select l_suppkey, qty, parts, round((qty - q0) / (q1 - q0), 10) as qty_scaled, round((parts - p0)::double / (p1 - p0), 10) as parts_scaled from s, e""")
def parallel_coordinates(t):
    out = c.parallel_coordinates(t.lineitem, "l_suppkey", [Measure("qty", "sum", "l_quantity"), Measure("parts", "count_distinct", "l_partkey")])
    return out.withColumns({"qty_scaled": F.round("qty_scaled", 10), "parts_scaled": F.round("parts_scaled", 10)})


@query("radar_profile", [247], f"""
    {_SCALE} select l_suppkey, 'qty' as measure, qty as value, round((qty - q0) / (q1 - q0), 10) as scaled from s, e
    union all select l_suppkey, 'parts', parts::double, round((parts - p0)::double / (p1 - p0), 10) from s, e""")
def radar_profile(t):
    out = c.radar_profile(t.lineitem, "l_suppkey", [Measure("qty", "sum", "l_quantity"), Measure("parts", "count_distinct", "l_partkey")])
    return out.withColumn("scaled", F.round("scaled", 10))


@query("stacked_100_percent", [248], """
    with g as (select date_trunc('month', o_orderdate)::date as month, o_orderpriority, count(*) as n from orders group by 1, 2)
    select *, round(n / sum(n) over (partition by month), 10) as share from g""")
def stacked_100_percent(t):
    df = t.orders.withColumn("month", F.trunc("o_orderdate", "month"))
    return c.stacked_100_percent(df, "month", "o_orderpriority", Measure("n", "count")).withColumn("share", F.round("share", 10))


@query("trend_line", [249], """
    select l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) as slope, round(regr_intercept(l_extendedprice, l_quantity), 4) as intercept,
      round(regr_r2(l_extendedprice, l_quantity), 8) as r2 from lineitem group by 1""")
def trend_line(t):
    return (c.trend_line(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"])
            .withColumns({"slope": F.round("slope", 5), "intercept": F.round("intercept", 4), "r2": F.round("r2", 8)}))
