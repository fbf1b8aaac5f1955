"""Layered models and column helpers."""

from pyspark.sql import functions as F

from tidemark.operators.filters import Filter
from tidemark.plans import models as p
from tidemark.plans.models import ModelColumn as C

from .registry import query


def _staged_orders(t):
    return p.staging_model(t.orders, ["order_id"], [
        C("order_id", "o_orderkey", "string"), C("customer_id", "o_custkey"), C("ordered_on", "o_orderdate", "date"),
        C("amount", "o_totalprice", "decimal(12,2)")], tenant="t1")


@query("staging_model", [35], """
    select o_orderkey::varchar as order_id, 't1' as tenant_id, o_custkey as customer_id, o_orderdate::date as ordered_on,
      o_totalprice::decimal(12, 2)::double as amount from orders""")
def staging_model(t):
    return _staged_orders(t).withColumn("amount", F.col("amount").cast("double"))


@query("intermediate_model", [36], """
    select c_mktsegment as segment, n_name as nation, count(*) as orders, round(sum(o_totalprice), 2) as amount
    from orders join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
    where o_orderstatus = 'F' and o_totalprice > 1000 group by 1, 2""")
def intermediate_model(t):
    spec = p.ModelSpec(
        sources={"orders": (t.orders, "o_orderstatus = 'F'"), "customer": t.customer, "nation": t.nation},
        joins=[p.ModelJoin("customer", {"o_custkey": "c_custkey"}, "inner"), p.ModelJoin("nation", {"c_nationkey": "n_nationkey"})],
        columns=[C("segment", "c_mktsegment"), C("nation", "n_name")], where=[Filter("o_totalprice", ">", 1000)],
        group_by=["segment", "nation"], aggregations={"orders": "count(*)", "amount": "round(sum(o_totalprice), 2)"})
    return p.build_model(spec)


@query("mart_model", [37], """
    select l_orderkey as order_id, l_linenumber as line, l_partkey, l_suppkey, p_brand as brand, s_name as supplier, round(l_extendedprice * (1 - l_discount), 4) as net
    from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey where l_returnflag = 'N'""")
def mart_model(t):
    return p.build_model(p.ModelSpec(
        sources={"lineitem": (t.lineitem, "l_returnflag = 'N'"), "part": t.part, "supplier": t.supplier},
        joins=[p.ModelJoin("part", {"l_partkey": "p_partkey"}), p.ModelJoin("supplier", {"l_suppkey": "s_suppkey"})],
        columns=[C("order_id", "l_orderkey"), C("line", "l_linenumber"), C("l_partkey"), C("l_suppkey"), C("brand", "p_brand"),
                 C("supplier", "s_name"), C("net", "round(l_extendedprice * (1 - l_discount), 4)")]))


@query("generic_model", [38], "select c_custkey, upper(c_name) as name, c_acctbal > 5000 as rich from customer where c_nationkey < 10")
def generic_model(t):
    return p.generic_model(t.customer, ["c_custkey", "upper(c_name) as name", "c_acctbal > 5000 as rich"], "c_nationkey < 10")


@query("visual_model", [39], """
    select r_name as region, p_type as kind, sum(l_quantity) as qty, count(distinct s_suppkey) as suppliers from lineitem
    join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where l_linestatus = 'O' group by 1, 2 having sum(l_quantity) > 1000 order by qty desc""")
def visual_model(t):
    return p.build_model(p.ModelSpec(
        sources={"lineitem": t.lineitem, "supplier": t.supplier, "part": t.part, "nation": t.nation, "region": t.region},
        joins=[p.ModelJoin("supplier", {"l_suppkey": "s_suppkey"}, "inner"), p.ModelJoin("part", {"l_partkey": "p_partkey"}, "inner"),
               p.ModelJoin("nation", {"s_nationkey": "n_nationkey"}, "inner"), p.ModelJoin("region", {"n_regionkey": "r_regionkey"}, "inner")],
        columns=[C("region", "r_name"), C("kind", "p_type")], where=["l_linestatus = 'O'"], group_by=["region", "kind"],
        aggregations={"qty": "sum(l_quantity)", "suppliers": "count(distinct s_suppkey)"}, having="qty > 1000", order_by=["-qty"]))


@query("snake_case_columns", [40], """
    select c_custkey as customer_key, c_name as customer_name, c_acctbal as customer_name_2, c_mktsegment as _2nd_segment from customer""")
def snake_case_columns(t):
    return p.snake_case_columns(t.customer.selectExpr("c_custkey as `CustomerKey`", "c_name as `Customer Name`",
                                                      "c_acctbal as `customer-name`", "c_mktsegment as `2nd Segment!`"))


@query("star_except", [58], "select o_orderkey as src_o_orderkey_v, o_custkey as src_o_custkey_v, o_orderstatus as src_o_orderstatus_v from orders")
def star_except(t):
    return p.star(t.orders, ["O_TOTALPRICE", "o_orderdate", "o_orderpriority"], "src_", "_v")


@query("filtered_columns", [59], "select s_suppkey, s_name, s_nationkey from supplier")
def filtered_columns(t):
    return t.supplier.select(*p.filtered_columns(t.supplier, ["s_acctbal"]))


@query("nullcheck", [60], "select event_id, nullif(case when event_type = 'error' then '' else event_type end, '') as event_type from events")
def nullcheck(t):
    return p.nullcheck(t.events.select("event_id", F.expr("case when event_type = 'error' then '' else event_type end").alias("event_type")))
