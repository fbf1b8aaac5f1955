"""Joins, lookups and graph walks."""

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.plans.semantic import SemanticQuery, semantic_query

from .registry import query
from .semantic import layer


@query("inner_join_theta", [61], """
    select o_orderkey, c_name, o_totalprice from orders join customer on o_custkey = c_custkey and o_totalprice > c_acctbal * 30""")
def inner_join_theta(t):
    return (j.equi_join(t.orders, t.customer, {"o_custkey": "c_custkey"}, "inner", "o_totalprice > c_acctbal * 30")
            .select("o_orderkey", "c_name", "o_totalprice"))


@query("left_join", [61], """
    select p_partkey, p_name, count(l_orderkey) as lines, coalesce(sum(l_quantity), 0) as qty
    from part left join lineitem on p_partkey = l_partkey group by 1, 2""")
def left_join(t):
    # the many side is reduced per key before it meets the dimension
    lines = (t.lineitem.groupBy("l_partkey")
             .agg(F.count("l_orderkey").alias("lines"), F.sum("l_quantity").alias("qty")))
    return (j.equi_join(t.part, lines, {"p_partkey": "l_partkey"}, "left")
            .select("p_partkey", "p_name", F.coalesce("lines", F.lit(0)).alias("lines"),
                    F.coalesce("qty", F.lit(0.0)).alias("qty")))


@query("right_join", [61], """
    select n_name, s_suppkey, s_name from supplier right join nation on s_nationkey = n_nationkey""")
def right_join(t):
    return j.equi_join(t.supplier, t.nation, {"s_nationkey": "n_nationkey"}, "right").select("n_name", "s_suppkey", "s_name")


@query("full_join", [61], """
    with a as (select c_nationkey as k, count(*) as customers from customer group by 1),
         b as (select s_nationkey as k, count(*) as suppliers from supplier group by 1)
    select coalesce(a.k, b.k) as k, customers, suppliers from a full join b on a.k = b.k""")
def full_join(t):
    a = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return j.equi_join(a, b, ["k"], "full")


@query("salted_join", [61], """
    select e.event_id, e.value, u.last_value, u.user_id from
    (select event_id, value, case when event_id % 3 = 0 then 1 else user_id end as user_id from events) e
    left join (select user_id, max(value) as last_value from events group by 1) u on e.user_id = u.user_id""")
def salted_join(t):
    left = t.events.select("event_id", "value", F.expr("case when event_id % 3 = 0 then 1 else user_id end").alias("user_id"))
    right = t.events.groupBy("user_id").agg(F.max("value").alias("last_value"))
    return j.salted_join(left, right, "user_id", "left")


@query("cross_join", [62], """
    select c_mktsegment, r_name, customers from (select c_mktsegment, count(*) as customers from customer group by 1), region""")
def cross_join(t):
    segments = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return j.small_cross_join(segments, t.region.select("r_name"))


@query("auto_join", [63], """
    select r_name as region, o_orderpriority as priority, sum(l_quantity) as quantity from lineitem
    join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2""")
def auto_join(t):
    return semantic_query(layer(t), SemanticQuery(["quantity"], ["region", "priority"]))


@query("many_to_many_join", [64], """
    select s_suppkey, p_brand, count(*) as parts from supplier
    join (select distinct l_suppkey, l_partkey from lineitem) b on s_suppkey = l_suppkey
    join part on l_partkey = p_partkey group by 1, 2""")
def many_to_many_join(t):
    joined = j.many_to_many_join(t.supplier.select("s_suppkey"), t.lineitem, t.part.select("p_partkey", "p_brand"),
                                 ("s_suppkey", "l_suppkey"), ("l_partkey", "p_partkey"))
    return joined.groupBy("s_suppkey", "p_brand").agg(F.count("*").alias("parts"))


@query("drill_across", [65], """
    with s as (select l_suppkey as supp, date_trunc('year', l_shipdate)::date as yr, sum(l_quantity) as shipped from lineitem group by 1, 2),
    o as (select o_custkey as supp, date_trunc('year', o_orderdate)::date as yr, count(*) as ordered from orders group by 1, 2)
    select coalesce(s.supp, o.supp) as supp, coalesce(s.yr, o.yr) as yr, shipped, ordered
    from s full join o on s.supp = o.supp and s.yr = o.yr""")
def drill_across(t):
    return j.drill_across([
        (t.lineitem, {"supp": "l_suppkey", "yr": "trunc(l_shipdate, 'year')"}, {"shipped": F.sum("l_quantity")}),
        (t.orders, {"supp": "o_custkey", "yr": "trunc(o_orderdate, 'year')"}, {"ordered": F.count("*")})])


@query("anti_join_orphans", [66], """
    select d.doc_id, d.source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)""")
def anti_join_orphans(t):
    return j.orphans(t.documents.select("doc_id", "source"), t.labels, "doc_id", "doc_id")


@query("semi_join", [66], """
    select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice > 480000)""")
def semi_join(t):
    return j.semi_join(t.customer.select("c_custkey", "c_name"), t.orders.filter("o_totalprice > 480000"), "c_custkey", "o_custkey")


_RATES = """select p_partkey as part, p_retailprice as rate, d as valid_from,
    case when d = date '1999-01-01' then null else (d + interval 2 year)::date end as valid_to
    from part, (values (date '1995-01-01'), (date '1996-07-01'), (date '1999-01-01')) v(d)"""


def _rates(t):
    dates = F.array(*[F.lit(d).cast("date") for d in ("1995-01-01", "1996-07-01", "1999-01-01")])
    return (t.part.select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("rate"),
                          F.explode(dates).alias("valid_from"))
            .withColumn("valid_to", F.when(F.col("valid_from") < F.lit("1999-01-01").cast("date"),
                                           F.add_months("valid_from", 24))))


@query("range_lookup", [67], f"""
    with rates as ({_RATES}), li as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        l_shipdate::date as ship from lineitem)
    select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, ship,
      (select max(valid_from) from rates where part = l_partkey and ship >= valid_from and (valid_to is null or ship <= valid_to)) as valid_from
    from li""")
def range_lookup(t):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ship"]
    points = t.lineitem.withColumn("ship", F.col("l_shipdate").cast("date")).select(*key)
    return (j.range_lookup(points, _rates(t), "ship", "valid_from", "valid_to", {"l_partkey": "part"}, key, "max")
            .select(*key, "valid_from"))


@query("key_lookup", [68], """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, coalesce(p_name, 'unknown') as p_name, coalesce(p_size, -1) as p_size
    from lineitem left join (select * from part where p_size > 10) on l_partkey = p_partkey""")
def key_lookup(t):
    facts = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return j.key_lookup(facts, t.part.filter("p_size > 10"), {"l_partkey": "p_partkey"}, {"p_name": "unknown", "p_size": -1})


@query("hierarchy_lookup", [69], """
    with recursive tree as (select c_custkey as node, case when c_custkey >= 10 then c_custkey // 10 end as parent from customer),
    up as (select node, parent as ancestor, 1 as distance from tree where parent is not null
      union all select up.node, tree.parent, distance + 1 from up join tree on up.ancestor = tree.node where tree.parent is not null)
    select node, ancestor, distance from up""")
def hierarchy_lookup(t):
    tree = t.customer.select(F.col("c_custkey").alias("node"),
                             F.expr("case when c_custkey >= 10 then c_custkey div 10 end").alias("parent"))
    return j.ancestors(tree, "node", "parent")


_IP = "concat('10.', {u} % 256, '.', ({u} * 7) % 256, '.', ({u} * 13) % 256)"


@query("ip_prefix_lookup", [70], """
    with e as (select event_id, '10.' || (user_id % 256) || '.' || ((user_id * 7) % 256) || '.' || ((user_id * 13) % 256) as ip,
        10 * 16777216 + (user_id % 256) * 65536 + ((user_id * 7) % 256) * 256 + (user_id * 13) % 256 as num from events),
    p as (select '10.' || n_nationkey || '.0.0/16' as prefix, n_name as net, (10 * 16777216 + n_nationkey * 65536)::bigint as lo, 65536 as size from nation
      union all select '10.0.0.0/8', 'all', (10 * 16777216)::bigint, 16777216
      union all select '10.' || n_nationkey || '.' || ((n_nationkey * 7) % 256) || '.0/24', n_name || '-x',
        (10 * 16777216 + n_nationkey * 65536 + ((n_nationkey * 7) % 256) * 256)::bigint, 256 from nation where n_nationkey % 2 = 0)
    select event_id, ip, arg_min(net, size) as net from e join p on num >= lo and num < lo + size group by 1, 2""")
def ip_prefix_lookup(t):
    events = t.events.select("event_id", F.expr(_IP.format(u="user_id")).alias("ip"))
    nets = t.nation.select(F.expr("concat('10.', n_nationkey, '.0.0/16')").alias("prefix"), F.col("n_name").alias("net"))
    whole = t.nation.filter("n_nationkey = 0").select(F.lit("10.0.0.0/8").alias("prefix"), F.lit("all").alias("net"))
    narrow = t.nation.filter("n_nationkey % 2 = 0").select(
        F.expr("concat('10.', n_nationkey, '.', (n_nationkey * 7) % 256, '.0/24')").alias("prefix"),
        F.concat("n_name", F.lit("-x")).alias("net"))
    return j.ip_prefix_lookup(events, nets.union(whole).union(narrow), "ip").select("event_id", "ip", "net")


@query("interval_join", [71], """
    with weeks as (select distinct date_trunc('week', o_orderdate)::date as week_start from orders)
    select week_start, count(*) as shipped from lineitem join weeks
    on l_shipdate::date >= week_start and l_shipdate::date <= week_start + 6 group by 1""")
def interval_join(t):
    weeks = (t.orders.select(F.date_trunc("week", "o_orderdate").cast("date").alias("week_start")).distinct()
             .withColumn("week_end", F.date_add("week_start", 6)))
    points = t.lineitem.select(F.col("l_shipdate").cast("date").alias("ship"))
    return (j.interval_join(points, weeks, "ship", "week_start", "week_end")
            .groupBy("week_start").agg(F.count("*").alias("shipped")))


@query("same_period_join", [72], """
    with m as (select o_orderpriority, date_trunc('month', o_orderdate)::date as month, count(*) as n from orders group by 1, 2)
    select a.o_orderpriority, a.month, a.n, b.n as prior_n from m a left join m b
    on a.o_orderpriority = b.o_orderpriority and b.month = (a.month - interval 12 month)::date""")
def same_period_join(t):
    m = t.orders.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    return j.same_period_join(m, ["o_orderpriority"], "month", ["n"], 12)


_EDGES = """select 'r' || n_regionkey as source, 'n' || n_nationkey as target from nation
    union all select 'n' || c_nationkey, 'c' || c_custkey from customer
    union all select 'c' || o_custkey, 'o' || o_orderkey from orders"""


def _edges(t):
    return (t.nation.selectExpr("concat('r', n_regionkey) as source", "concat('n', n_nationkey) as target")
            .union(t.customer.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)"))
            .union(t.orders.selectExpr("concat('c', o_custkey)", "concat('o', o_orderkey)")))


@query("lineage_downstream", [73], f"""
    with recursive edges as ({_EDGES}), walk as (select 'r2' as node, 0 as depth
    union select target, depth + 1 from walk join edges on node = source where depth < 3)
    select node, min(depth) as depth from walk group by 1""")
def lineage_downstream(t):
    roots = t.region.filter("r_regionkey = 2").selectExpr("concat('r', r_regionkey) as node")
    return j.lineage_traverse(_edges(t), roots, "downstream", 3)


@query("lineage_upstream", [73], f"""
    with recursive edges as ({_EDGES}), walk as (select 'o' || o_orderkey as node, 0 as depth from orders where o_totalprice > 499000
    union select source, depth + 1 from walk join edges on node = target)
    select node, min(depth) as depth from walk group by 1""")
def lineage_upstream(t):
    roots = t.orders.filter("o_totalprice > 499000").selectExpr("concat('o', o_orderkey) as node")
    return j.lineage_traverse(_edges(t), roots, "upstream")


@query("impact_counts", [74], """
    select kind, n from (select 'nation' as kind, count(*) as n from nation where n_regionkey = 1
    union all select 'customer', count(*) from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1
    union all select 'order', count(*) from orders join customer on o_custkey = c_custkey
      join nation on c_nationkey = n_nationkey where n_regionkey = 1)""")
def impact_counts(t):
    kinds = (t.nation.selectExpr("concat('n', n_nationkey) as node", "'nation' as kind")
             .union(t.customer.selectExpr("concat('c', c_custkey)", "'customer'"))
             .union(t.orders.selectExpr("concat('o', o_orderkey)", "'order'")))
    roots = t.region.filter("r_regionkey = 1").selectExpr("concat('r', r_regionkey) as node")
    return j.impact_counts(_edges(t), roots, kinds)


@query("interval_join_far_ends", [71], """
    with r as (select n_nationkey as id, timestamp '2024-01-01' + to_days(n_nationkey::int) as a,
      case when n_nationkey % 3 = 0 then timestamp '9999-12-31' when n_nationkey % 3 = 1 then null else timestamp '2024-01-20' end as z from nation)
    select event_type, id, count(*) as n from events join r on ts >= a and (z is null or ts <= z) group by 1, 2""")
def interval_join_far_ends(t):
    ranges = t.nation.selectExpr(
        "n_nationkey as id", "timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(n_nationkey as int)) as a",
        "case when n_nationkey % 3 = 0 then timestamp_ntz '9999-12-31' when n_nationkey % 3 = 1 then null else timestamp_ntz '2024-01-20' end as z")
    return j.interval_join(t.events, ranges, "ts", "a", "z").groupBy("event_type", "id").agg(F.count("*").alias("n"))


_MIXED = """with r as (
      select o_orderkey as id, o_custkey as cust, o_orderdate::timestamp as a, o_orderdate::timestamp + to_minutes(1) as z from orders where o_orderstatus = 'P'
      union all select o_orderkey, o_custkey, o_orderdate::timestamp, o_orderdate::timestamp + to_years(10) from orders where o_orderstatus = 'O' and o_totalprice > 494000
      union all select o_orderkey, o_custkey, o_orderdate::timestamp, null from orders where o_orderstatus = 'F' and o_totalprice > 498000)"""


def _mixed_ranges(t):
    """Ranges of a minute, of a decade and without an end, one table."""
    begin = F.col("o_orderdate").cast("timestamp_ntz")
    cut = lambda where, end: t.orders.filter(where).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), begin.alias("a"), end.cast("timestamp_ntz").alias("z"))
    return (cut("o_orderstatus = 'P'", begin + F.expr("interval 1 minute"))
            .unionByName(cut("o_orderstatus = 'O' and o_totalprice > 494000", begin + F.expr("interval 10 year")))
            .unionByName(cut("o_orderstatus = 'F' and o_totalprice > 498000", F.lit(None))))


@query("interval_join_mixed", [71], _MIXED + """
    select id, count(*) as ordered, min(o_orderdate::timestamp) as first_order from orders join r on o_orderdate::timestamp >= a and (z is null or o_orderdate::timestamp <= z) group by 1""")
def interval_join_mixed(t):
    points = t.orders.select(F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    held = j.interval_join(points, _mixed_ranges(t), "at", "a", "z", per_range={"ordered": "count", "first_order": "min"})
    return held.groupBy("id").agg(F.sum("ordered").alias("ordered"), F.min("first_order").alias("first_order"))


@query("interval_join_mixed_keyed", [67, 71], _MIXED + """
    select o_orderkey, id from orders left join r on cust = o_custkey and o_orderdate::timestamp >= a and (z is null or o_orderdate::timestamp <= z)""")
def interval_join_mixed_keyed(t):
    points = t.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    return j.interval_join(points, _mixed_ranges(t), "at", "a", "z", {"o_custkey": "cust"}, "left").select("o_orderkey", "id")


# the third group of an address and the prefixes say the same in numbers, which is what the oracle compares
@query("ip_prefix_lookup_both", [70], """
    with e as (select event_id, user_id, user_id % 256 as g, (user_id * 7) % 256 as h from events),
    a as (select event_id, case event_id % 4 when 0 then '2001:db8:' || to_hex(g) || '::' || to_hex(h) when 1 then '2001:0DB8:' || lower(to_hex(g)) || ':0:0:0:0:' || to_hex(h)
        when 2 then '::ffff:10.' || g || '.0.' || h else 'not an address' end as ip, event_id % 4 as kind, g, h from e),
    p as (select n_nationkey as g, n_name as net from nation)
    select event_id, ip, case when kind = 3 then null when kind = 2 then 'four' when h < 16 and p.net is not null then p.net || '-low' else coalesce(p.net, 'doc') end as net
    from a left join p on a.g = p.g""")
def ip_prefix_lookup_both(t):
    g, h = "cast(user_id % 256 as bigint)", "cast((user_id * 7) % 256 as bigint)"
    ip = F.expr(f"""case event_id % 4 when 0 then concat('2001:db8:', hex({g}), '::', hex({h})) when 1 then concat('2001:0DB8:', lower(hex({g})), ':0:0:0:0:', hex({h}))
        when 2 then concat('::ffff:10.', {g}, '.0.', {h}) else 'not an address' end""")
    one = t.nation.filter("n_nationkey = 0")
    nets = (t.nation.selectExpr("concat('2001:db8:', hex(n_nationkey), '::/48') as prefix", "n_name as net")
            .unionByName(t.nation.selectExpr("concat('2001:db8:', hex(n_nationkey), '::/124') as prefix", "concat(n_name, '-low') as net"))
            .unionByName(one.selectExpr("'2001:db8::/32' as prefix", "'doc' as net")).unionByName(one.selectExpr("'10.0.0.0/8' as prefix", "'four' as net"))
            .unionByName(one.selectExpr("'10.0.0.0/99' as prefix", "'bad' as net")))
    return j.ip_prefix_lookup(t.events.select("event_id", ip.alias("ip")), nets, "ip").select("event_id", "ip", "net")
