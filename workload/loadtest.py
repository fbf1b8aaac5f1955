"""The interactive query set (lookups, joins, group-bys) bound to the given tables.

customers: customer, region over nation and region, status = market segment;
orders: orders; order items: lineitem; products: part.
"""

from pyspark.sql import functions as F

from tidemark.operators.filters import Filter, relative_period
from tidemark.operators.measures import Measure, aggregate
from tidemark.plans.semantic import page
from tidemark.plans.shapes import aggregation_query, period

from .registry import query

AS_OF = "2001-08-01"


def _since(days):
    return relative_period("o_orderdate", "last_n_days", AS_OF, days)


def _since_sql(days):
    return f"o_orderdate >= timestamp '{AS_OF}' - interval {days - 1} day and o_orderdate < timestamp '{AS_OF}' + interval 1 day"


def _located(t):
    geo = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("region"))
    return t.customer.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))


@query("lookup_recent_orders", [41, 52, 115], f"select o_orderkey, o_totalprice from orders where {_since_sql(1)} order by o_orderkey limit 100")
def lookup_recent_orders(t):
    return page(t.orders.filter(_since(1)).select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100)


@query("lookup_orders", [115], "select * replace (o_orderdate::date as o_orderdate) from orders order by o_orderkey limit 100")
def lookup_orders(t):
    return page(t.orders, ["o_orderkey"], 100).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


@query("lookup_customers_by_status", [41, 115], "select * from customer where c_mktsegment = 'BUILDING' order by c_custkey limit 50")
def lookup_customers_by_status(t):
    return page(t.customer.filter(Filter("c_mktsegment", "=", "BUILDING").to_column()), ["c_custkey"], 50)


@query("lookup_products_by_category", [41, 115], "select * from part where p_type = 'PROMO' order by p_partkey limit 100")
def lookup_products_by_category(t):
    return page(t.part.filter(Filter("p_type", "=", "PROMO").to_column()), ["p_partkey"], 100)


@query("lookup_customer_names", [115], "select c_custkey, c_name, c_mktsegment from customer order by c_custkey limit 200")
def lookup_customer_names(t):
    return page(t.customer.select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], 200)


@query("join_top_customers", [61, 88], f"""
    select c_custkey, c_name, count(o_orderkey) as order_count, round(sum(o_totalprice), 2) as total_spent from customer join orders on c_custkey = o_custkey
    where {_since_sql(90)} group by 1, 2 order by total_spent desc, c_custkey limit 100""")
def join_top_customers(t):
    # reduce per customer first: the join then meets one row per customer
    spent = aggregate(t.orders.filter(_since(90)), ["o_custkey"], [Measure("order_count", "count", "o_orderkey"), Measure("total_spent", "sum", "o_totalprice")])
    top = page(spent.withColumn("total_spent", F.round("total_spent", 2)), ["-total_spent", "o_custkey"], 100)
    return (top.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select("c_custkey", "c_name", "order_count", "total_spent"))


@query("join_product_revenue", [61, 76, 88], """
    select p_partkey, p_name as product_name, p_type as category, count(distinct o_custkey) as unique_customers, sum(l_quantity) as total_quantity,
      round(sum(l_quantity * l_extendedprice), 2) as revenue from part join lineitem on p_partkey = l_partkey join orders on l_orderkey = o_orderkey
    where o_orderstatus = 'F' group by 1, 2, 3 order by revenue desc, p_partkey limit 50""")
def join_product_revenue(t):
    done = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    sold = items.join(done, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey").agg(
        F.count_distinct("o_custkey").alias("unique_customers"), F.sum("l_quantity").alias("total_quantity"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("revenue"))
    # product attributes are fetched for the fifty winners only
    top = page(sold, ["-revenue", "l_partkey"], 50)
    return top.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        "p_partkey", F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), "unique_customers", "total_quantity", "revenue")


@query("join_customer_baskets", [61, 76, 93], f"""
    select c_custkey, c_name as customer_name, r_name as region, count(distinct o_orderkey) as orders, count(distinct l_partkey) as unique_products,
      round(sum(o_totalprice), 2) as total_revenue from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey
      join part on l_partkey = p_partkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where {_since_sql(90)} group by 1, 2, 3 having count(distinct o_orderkey) >= 2 order by total_revenue desc, c_custkey limit 100""")
def join_customer_baskets(t):
    recent = t.orders.filter(_since(90)).select("o_orderkey", "o_custkey", "o_totalprice")
    items = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    per = recent.join(items, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("unique_products"),
        F.round(F.sum("o_totalprice"), 2).alias("total_revenue"))
    top = page(per.filter("orders >= 2"), ["-total_revenue", "o_custkey"], 100)
    return top.join(_located(t), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_custkey", F.col("c_name").alias("customer_name"), "region", "orders", "unique_products", "total_revenue")


@query("group_orders_by_month", [75, 87], f"""
    select date_trunc('month', o_orderdate)::date as month, count(*) as orders, round(sum(o_totalprice), 2) as revenue, round(avg(o_totalprice), 6) as avg_order,
      min(o_totalprice) as min_order, max(o_totalprice) as max_order from orders where {_since_sql(365)} group by 1""")
def group_orders_by_month(t):
    out = aggregate(t.orders.filter(_since(365)).withColumn("month", period("o_orderdate", "month")), ["month"], [
        Measure("orders", "count"), Measure("revenue", "sum", "o_totalprice"), Measure("avg_order", "avg", "o_totalprice"),
        Measure("min_order", "min", "o_totalprice"), Measure("max_order", "max", "o_totalprice")])
    return out.withColumns({"revenue": F.round("revenue", 2), "avg_order": F.round("avg_order", 6)})


@query("group_orders_by_month_region", [75, 87], f"""
    select date_trunc('month', o_orderdate)::date as month, r_name as region, count(*) as orders, round(sum(o_totalprice), 2) as revenue, round(sum(o_totalprice) / count(*), 6) as avg_order
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where {_since_sql(365)} group by 1, 2""")
def group_orders_by_month_region(t):
    # one row per customer and month before the join, one per region after it
    per = aggregate(t.orders.filter(_since(365)).withColumn("month", period("o_orderdate", "month")), ["o_custkey", "month"],
                    [Measure("n", "count"), Measure("total", "sum", "o_totalprice")])
    joined = per.join(_located(t).select("c_custkey", "region"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("month", "region").agg(F.sum("n").alias("orders"), F.round(F.sum("total"), 2).alias("revenue"),
                                                 F.round(F.sum("total") / F.sum("n"), 6).alias("avg_order"))


@query("group_orders_by_week_hour", [143], f"""
    select (o_orderdate::date - extract(dow from o_orderdate)::int)::date as week, isodow(o_orderdate)::int as day_of_week, hour(o_orderdate)::int as hour, count(*) as orders, round(sum(o_totalprice), 2) as revenue
    from orders where {_since_sql(90)} group by 1, 2, 3""")
def group_orders_by_week_hour(t):
    from tidemark.functions.columns import day_of_week_monday

    df = t.orders.filter(_since(90)).withColumns({"week": period("o_orderdate", "week"), "day_of_week": day_of_week_monday("o_orderdate"), "hour": F.hour("o_orderdate")})
    return (aggregate(df, ["week", "day_of_week", "hour"], [Measure("orders", "count"), Measure("revenue", "sum", "o_totalprice")])
            .withColumn("revenue", F.round("revenue", 2)))


@query("group_products_by_category", [75, 76], """
    select p_type, count(distinct p_partkey) as product_count, sum(p_size)::bigint as total_stock, round(avg(p_retailprice), 6) as avg_price, min(p_retailprice) as min_price, max(p_retailprice) as max_price from part group by 1""")
def group_products_by_category(t):
    return aggregation_query(t.part, ["p_type"], [
        Measure("product_count", "count_distinct", "p_partkey"), Measure("total_stock", "sum", "p_size"), Measure("avg_price", "avg", "p_retailprice"),
        Measure("min_price", "min", "p_retailprice"), Measure("max_price", "max", "p_retailprice")], order_by=["-product_count", "p_type"]
    ).withColumn("avg_price", F.round("avg_price", 6))


@query("group_customers_by_region_status", [61, 75], """
    with o as (select o_custkey, count(*) as n, sum(o_totalprice) as spent from orders group by 1)
    select r_name as region, c_mktsegment as status, count(*) as customer_count, coalesce(sum(n), 0)::bigint as total_orders, round(avg(spent), 5) as avg_spent
    from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join o on c_custkey = o_custkey group by 1, 2""")
def group_customers_by_region_status(t):
    spent = aggregate(t.orders, ["o_custkey"], [Measure("n", "count"), Measure("spent", "sum", "o_totalprice")])
    df = _located(t).join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return df.groupBy("region", F.col("c_mktsegment").alias("status")).agg(
        F.count(F.lit(1)).alias("customer_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_orders"), F.round(F.avg("spent"), 5).alias("avg_spent"))
