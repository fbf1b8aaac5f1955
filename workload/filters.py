"""Filters, row visibility and derived columns."""

from pyspark.sql import functions as F

from tidemark.operators import filters as f
from tidemark.operators.filters import Filter

from .registry import query

ORDERS = "select o_orderkey from orders where "


def order_keys(t, *conditions):
    return f.filter_rows(t.orders, *conditions).select("o_orderkey")


@query("filter_comparisons", [41], ORDERS + "o_orderstatus = 'F' and o_orderpriority <> '5-LOW' and o_custkey != 3 "
       "and o_totalprice > 1000 and o_totalprice <= 300000 and o_custkey >= 10 and o_orderkey < 100000000")
def filter_comparisons(t):
    return order_keys(t, Filter("o_orderstatus", "=", "F"), Filter("o_orderpriority", "<>", "5-LOW"),
                      Filter("o_custkey", "!=", 3), Filter("o_totalprice", ">", 1000),
                      Filter("o_totalprice", "<=", 300000), Filter("o_custkey", ">=", 10),
                      Filter("o_orderkey", "<", 100000000))


@query("filter_in", [42], ORDERS + "o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus in ('O')")
def filter_in(t):
    return order_keys(t, Filter("o_orderpriority", "IN", ["1-URGENT", "2-HIGH"]), Filter("o_orderstatus", "in", "O"),
                      Filter("o_custkey", "in", []))


@query("filter_not_in", [42], ORDERS + "o_orderpriority not in ('1-URGENT', '2-HIGH')")
def filter_not_in(t):
    return order_keys(t, Filter("o_orderpriority", "NOT IN", ["1-URGENT", "2-HIGH"]), Filter("o_custkey", "not in", []))


@query("filter_like_contains", [43], """
    select p_partkey from part where p_name like 'red%' and p_type not like '%MO' and contains(p_name, 'et')""")
def filter_like_contains(t):
    return f.filter_rows(t.part, Filter("p_name", "LIKE", "red%"), Filter("p_type", "NOT LIKE", "%MO"),
                         Filter("p_name", "contains", "et")).select("p_partkey")


@query("filter_ilike", [44], "select p_partkey, p_name from part where p_name ilike '%WIDGET%'")
def filter_ilike(t):
    return f.filter_rows(t.part, Filter("p_name", "ILIKE", "%WIDGET%")).select("p_partkey", "p_name")


@query("filter_similar_to", [45], "select p_partkey from part where regexp_full_match(p_brand, 'Brand#(1|2)[0-9]')")
def filter_similar_to(t):
    return f.filter_rows(t.part, Filter("p_brand", "SIMILAR TO", "Brand#(1|2)[0-9]")).select("p_partkey")


@query("filter_between", [46], ORDERS + "o_totalprice between 100000 and 200000 "
       "and o_orderdate between timestamp '1996-03-01' and timestamp '1997-03-01'")
def filter_between(t):
    return order_keys(t, Filter("o_totalprice", "BETWEEN", [100000, 200000]),
                      Filter("cast(o_orderdate as date)", "between", {"start": "1996-03-01", "end": "1997-03-01"}))


@query("filter_null_tests", [47], """
    select nullif(l.toxic, 0) is null as clean, nullif(l.quality, 0) is not null as good, count(*) as n
    from documents d left join labels l using (doc_id)
    where nullif(l.quality, 0) is not null or nullif(l.toxic, 0) is null group by 1, 2""")
def filter_null_tests(t):
    df = t.documents.join(t.labels, "doc_id", "left")
    good = Filter("nullif(quality, 0)", "is not null").to_column()
    clean = Filter("nullif(toxic, 0)", "is null").to_column()
    return df.filter(good | clean).groupBy(clean.alias("clean"), good.alias("good")).agg(F.count("*").alias("n"))


@query("filter_outside_range", [48], "select event_id, value from events where not (value between 1 and 100)")
def filter_outside_range(t):
    return f.filter_rows(t.events, Filter("value", "outside", [1, 100])).select("event_id", "value")


@query("metric_filter_map", [49], """
    select count(*) as n, round(sum(o_totalprice), 2) as total from orders
    where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '3-MEDIUM') and o_totalprice >= 50000""")
def metric_filter_map(t):
    spec = {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "3-MEDIUM"],
            "o_totalprice": {"operator": ">=", "value": 50000}}
    return (f.filter_rows(t.orders, *f.filters_from_map(spec))
            .agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")))


@query("merge_filters", [50], ORDERS + "o_orderstatus = 'F' and o_custkey < 500 and o_orderpriority = '2-HIGH'")
def merge_filters(t):
    local, shared = [Filter("o_orderstatus", "=", "F")], [Filter("o_custkey", "<", 500), Filter("o_orderstatus", "=", "F")]
    return order_keys(t, *f.merge_filters(local, shared, [Filter("o_orderpriority", "=", "2-HIGH")]))


@query("time_range_filter", [51], ORDERS + "o_orderdate >= timestamp '1998-02-01' and o_orderdate <= timestamp '1998-04-30'")
def time_range_filter(t):
    return order_keys(t, f.time_range("o_orderdate", "1998-02-01", "1998-04-30"))


_PERIODS = {"today": ("1998-05-20", "1998-05-21"), "yesterday": ("1998-05-19", "1998-05-20"),
            "last_week": ("1998-05-10", "1998-05-17"), "last_month": ("1998-04-01", "1998-05-01"),
            "last_quarter": ("1998-01-01", "1998-04-01"), "last_year": ("1997-01-01", "1998-01-01"),
            "mtd": ("1998-05-01", "1998-05-21"), "qtd": ("1998-04-01", "1998-05-21"),
            "ytd": ("1998-01-01", "1998-05-21"), "last_n_days": ("1998-04-21", "1998-05-21")}


@query("relative_period_filter", [52], " union all ".join(
    f"select '{p}' as period, count(*) as n from orders where o_orderdate >= timestamp '{a}' "
    f"and o_orderdate < timestamp '{b}'" for p, (a, b) in _PERIODS.items()))
def relative_period_filter(t):
    flags = {p: f.relative_period("o_orderdate", p, "1998-05-20", 30) for p in _PERIODS}
    wide = t.orders.agg(*[F.count_if(c).alias(p) for p, c in flags.items()])
    return wide.unpivot([], list(flags), "period", "n")


@query("tenant_filter", [53], """
    select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey
    where o.o_custkey % 3 = 1""")
def tenant_filter(t):
    tenant = lambda key: F.concat(F.lit("t"), F.pmod(F.col(key), F.lit(3)))
    orders = f.tenant_rows(t.orders.withColumn("tenant_id", tenant("o_custkey")), "t1")
    customers = f.tenant_rows(t.customer.withColumn("tenant_id", tenant("c_custkey")), "t1")
    return (orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name"))


@query("row_policy_filter", [54], """
    select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')
    and c_nationkey in (select n_nationkey from nation where n_regionkey = 2)""")
def row_policy_filter(t):
    user = {"name": "ann", "roles": ["analyst"], "segments": ["BUILDING", "MACHINERY"]}
    policies = [f.RowPolicy("c_mktsegment", "segments"), f.RowPolicy("c_name", "names", frozenset({"analyst"}))]
    grants = t.nation.filter("n_regionkey = 2").select(F.lit("ann").alias("user_name"), "n_nationkey")
    seen = f.visible_rows(t.customer, policies, user)
    return f.visible_rows_by_grant(seen, grants, "ann", {"c_nationkey": "n_nationkey"}).select("c_custkey", "c_mktsegment")


@query("derived_column", [55], """
    select l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge,
           case when l_quantity >= 30 then 'bulk' when l_quantity >= 10 then 'case' else 'unit' end as size_class,
           if(l_returnflag = 'R', 1, 0) as returned, coalesce(nullif(l_discount, 0), 0.5) as disc
    from lineitem""")
def derived_column(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.expr("round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6)").alias("charge"),
        F.expr("case when l_quantity >= 30 then 'bulk' when l_quantity >= 10 then 'case' else 'unit' end").alias("size_class"),
        F.expr("if(l_returnflag = 'R', 1, 0)").alias("returned"),
        F.expr("coalesce(nullif(l_discount, 0D), 0.5D)").alias("disc"))


@query("bucket_column", [56], """
    select case when o_totalprice < 50000 then 'small' when o_totalprice < 200000 then 'medium' else 'large' end as band,
           count(*) as n from orders group by 1""")
def bucket_column(t):
    band = f.bucket_column("o_totalprice", [(50000, "small"), (200000, "medium")], "large")
    return t.orders.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("parameterized_query", [57], """
    select o_orderpriority, count(*) as n from orders where o_totalprice >= 150000 and o_orderstatus = 'O' group by 1""")
def parameterized_query(t):
    from tidemark.sources.readers import run_parameterized

    return run_parameterized(t.spark, "select o_orderpriority, count(*) as n from orders_v "
                             "where o_totalprice >= {{floor}} and o_orderstatus = {{ status }} group by 1",
                             {"floor": 150000, "status": "O"}, orders_v=t.orders)
