"""Ranking, navigation, running totals, shares, set operations, deduplication."""

from pyspark.sql import functions as F

from tidemark.operators import sets, windows as w
from tidemark.sources.readers import read_query

from .registry import query

EVENT = ["user_id", "event_id", "ts"]


def _monthly(t, *keys):
    return (t.orders.groupBy(*keys, F.trunc("o_orderdate", "month").alias("month"))
            .agg(F.sum(F.expr("cast(o_totalprice * 100 as bigint)")).alias("cents")))


@query("window_rankings", [105], """
    select user_id, event_id, row_number() over w as row_number, rank() over v as rank, dense_rank() over v as dense_rank
    from events window w as (partition by user_id order by event_type, event_id), v as (partition by user_id order by event_type)""")
def window_rankings(t):
    df = t.events.select("user_id", "event_id", "event_type")
    numbered = w.number_rows(df, ["user_id"], ["event_type", "event_id"])
    return w.rank_rows(numbered, ["user_id"], ["event_type"]).drop("event_type")


@query("window_rankings_global", [105], """
    select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as row_number,
           rank() over (order by o_orderdate) as rank, dense_rank() over (order by o_orderdate) as dense_rank from orders""")
def window_rankings_global(t):
    df = w.number_rows(t.orders.select("o_orderkey", "o_orderdate"), [], ["o_orderdate", "o_orderkey"])
    return w.rank_rows(df, [], ["o_orderdate"]).drop("o_orderdate")


@query("window_ntile", [105], """
    select c_custkey, ntile(7) over (partition by c_mktsegment order by c_acctbal desc, c_custkey)::int as tile from customer""")
def window_ntile(t):
    return (w.ntile(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_mktsegment"],
                    ["-c_acctbal", "c_custkey"], 7, "tile").select("c_custkey", "tile"))


@query("window_lag_lead", [106], """
    select event_id, lag(value) over w as lag_value, lead(value) over w as lead_value from events
    window w as (partition by user_id order by ts, event_id)""")
def window_lag_lead(t):
    return (w.lag_lead(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value")
            .select("event_id", "lag_value", "lead_value"))


@query("window_first_last", [106], """
    select o_orderkey, first_value(o_totalprice) over w as first_o_totalprice, last_value(o_totalprice) over w as last_o_totalprice
    from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)""")
def window_first_last(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return (w.first_last(df, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice")
            .select("o_orderkey", "first_o_totalprice", "last_o_totalprice"))


@query("running_total", [107], """
    select event_id, sum((value * 100)::bigint) over (partition by event_type order by ts, event_id rows unbounded preceding)::bigint as running_total
    from events""")
def running_total(t):
    df = t.events.select("event_id", "event_type", "ts", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return w.running_total(df, ["event_type"], ["ts", "event_id"], "cents").select("event_id", "running_total")


@query("running_total_over_aggregate", [107], """
    with m as (select o_orderstatus, date_trunc('month', o_orderdate)::date as month, sum(round(o_totalprice * 100)::bigint)::bigint as cents
      from orders group by 1, 2)
    select o_orderstatus, month, sum(cents) over (partition by o_orderstatus order by month)::bigint as running_total from m""")
def running_total_over_aggregate(t):
    m = (t.orders.groupBy("o_orderstatus", F.trunc("o_orderdate", "month").alias("month"))
         .agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")))
    return w.running_total(m, ["o_orderstatus"], ["month"], "cents").drop("cents")


@query("moving_average_running_count", [108], """
    select event_id, round(avg(value) over (w rows between 6 preceding and current row), 6) as moving_average,
           count(value) over (w rows unbounded preceding) as running_count
    from events window w as (partition by event_type order by ts, event_id)""")
def moving_average_running_count(t):
    df = t.events.select("event_id", "event_type", "ts", "value")
    avg = w.moving_average(df, ["event_type"], ["ts", "event_id"], "value", 7)
    return (w.running_count(avg, ["event_type"], ["ts", "event_id"], "value")
            .select("event_id", F.round("moving_average", 6).alias("moving_average"), "running_count"))


@query("percent_of_total", [109], """
    with g as (select n_regionkey, c_nationkey, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by 1, 2)
    select n_regionkey, c_nationkey, round(customers / sum(customers) over (), 10) as share,
           round(customers / sum(customers) over (partition by n_regionkey), 10) as share_in_region from g""")
def percent_of_total(t):
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    g = per_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_nationkey", "customers")
    out = w.percent_of_total(w.percent_of_total(g, "customers"), "customers", ["n_regionkey"], "share_in_region")
    return out.select("n_regionkey", "c_nationkey", F.round("share", 10).alias("share"),
                      F.round("share_in_region", 10).alias("share_in_region"))


@query("period_growth", [110], """
    with m as (select o_orderpriority, date_trunc('month', o_orderdate)::date as month, count(*) as n from orders group by 1, 2)
    select *, lag(n) over w as previous_n, round((n - lag(n) over w) / lag(n) over w, 10) as growth
    from m window w as (partition by o_orderpriority order by month)""")
def period_growth(t):
    m = t.orders.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return w.period_growth(m, ["o_orderpriority"], "month", "n").withColumn("growth", F.round("growth", 10))


@query("year_over_year_aligned", [111], """
    with d as (select l_shipdate::date as day, sum(l_quantity) as qty from lineitem group by 1)
    select a.day, a.qty, b.qty as prior_qty from d a left join d b on b.day = a.day - 364""")
def year_over_year_aligned(t):
    d = t.lineitem.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").alias("qty"))
    return w.year_over_year(d, [], "day", "qty")


@query("year_over_year_same_date", [111], """
    with d as (select l_returnflag, l_shipdate::date as day, sum(l_quantity) as qty from lineitem group by 1, 2)
    select a.l_returnflag, a.day, a.qty, b.qty as prior_qty from d a left join d b
    on b.day = (a.day - interval 1 year)::date and a.l_returnflag = b.l_returnflag""")
def year_over_year_same_date(t):
    d = (t.lineitem.groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("day"))
         .agg(F.sum("l_quantity").alias("qty")))
    return w.year_over_year(d, ["l_returnflag"], "day", "qty", aligned=False)


@query("top_percent", [112], """
    with c as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by 1),
    r as (select *, row_number() over (order by spent desc, o_custkey) as rn, count(*) over () as n from c)
    select o_custkey, spent from r where rn <= ceil(n * 20 / 100.0)""")
def top_percent(t):
    c = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return w.top_percent(c, ["-spent", "o_custkey"], 20)


@query("rank_by_measure", [113], """
    select l_suppkey, n, rank() over (order by n desc) as rank from (select l_suppkey, count(*) as n from lineitem group by 1)""")
def rank_by_measure(t):
    return w.rank_by_measure(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n")), "n")


@query("union_relations", [116], """
    select 'customer' as source_relation, c_custkey as key, c_name as name, null as brand, c_acctbal::varchar as amount from customer
    union all select 'part', p_partkey, p_name, p_brand, p_size::varchar from part""")
def union_relations(t):
    a = t.customer.selectExpr("c_custkey as key", "c_name as name", "c_acctbal as amount", "c_mktsegment as hidden")
    b = t.part.selectExpr("p_partkey as key", "p_name as name", "p_brand as brand", "p_size as amount")
    return sets.union_relations({"customer": a, "part": b}, exclude=["hidden"])


@query("except_both_ways", [117], """
    with a as (select distinct o_custkey as k from orders where o_orderstatus = 'F'),
         b as (select distinct o_custkey as k from orders where o_orderstatus = 'O')
    select k, 'finished_minus_open' as which_diff from (select k from a except select k from b)
    union all select k, 'open_minus_finished' from (select k from b except select k from a)""")
def except_both_ways(t):
    pick = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return sets.except_both_ways(pick("F"), pick("O"), "finished", "open")


@query("intersect", [117], """
    select o_custkey as k from orders intersect select c_custkey from customer""")
def intersect(t):
    return sets.intersect(t.orders.select(F.col("o_custkey").alias("k")),
                          t.customer.select(F.col("c_custkey").alias("k")))


@query("deduplicate", [118], """
    select l_orderkey, l_partkey, l_quantity, l_shipdate::date as ship from lineitem
    qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_suppkey, l_linenumber, l_extendedprice) = 1""")
def deduplicate(t):
    out = w.deduplicate(t.lineitem, ["l_orderkey"], ["-l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_quantity", F.col("l_shipdate").cast("date").alias("ship"))


@query("latest_version", [119], """
    select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn
    from events) where rn = 1""")
def latest_version(t):
    return (w.latest_version(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts")
            .drop("ts"))


_CTE = """
    with big as (select o_custkey, o_orderkey, o_totalprice from {o} o
        where o_totalprice > (select avg(o_totalprice) from {o} i where i.o_custkey = o.o_custkey)),
    per as (select o_custkey, count(*) as n from big group by o_custkey)
    select s.c_mktsegment, sum(s.n) as n from (select c.c_mktsegment, p.n from per p join {c} c on p.o_custkey = c.c_custkey
        where c.c_nationkey in (select n_nationkey from {n} where n_regionkey < 3)) s group by s.c_mktsegment"""


@query("cte_subqueries", [2, 120],
       "select c_mktsegment, n::bigint as n from (" + _CTE.format(o="orders", c="customer", n="nation") + ")")
def cte_subqueries(t):
    return read_query(t.spark, _CTE, o=t.orders, c=t.customer, n=t.nation)
