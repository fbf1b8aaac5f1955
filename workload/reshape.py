"""Pivot, unpivot, keys, series, geography, URLs and safe arithmetic."""

import xxhash
from pyspark.sql import functions as F

from tidemark.functions import columns as c
from tidemark.operators import reshape as r

from .registry import query


@query("pivot", [121, 135], """
    select o_orderstatus, sum(case when o_orderpriority = '1-URGENT' then 1 else 0 end)::bigint as p__1_urgent,
      sum(case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end)::bigint as p__4_not_specified from orders group by 1""")
def pivot(t):
    return r.pivot(t.orders, ["o_orderstatus"], "o_orderpriority", ["1-URGENT", "4-NOT SPECIFIED"], prefix="p_", slug=True)


@query("pivot_values", [104, 121], """
    select l_returnflag, max(case when l_linestatus = 'F' then l_quantity end) as "max_F", max(case when l_linestatus = 'O' then l_quantity end) as "max_O"
    from lineitem group by 1""")
def pivot_values(t):
    values = r.pivot_values(t.lineitem, "l_linestatus")
    return r.pivot(t.lineitem, ["l_returnflag"], "l_linestatus", values, "max", prefix="max_", then="l_quantity", otherwise=None)


@query("pivot_distinct", [121], """
    select event_type, count(distinct case when user_id >= 50 then user_id end) as "u_50", count(distinct case when user_id >= 100 then user_id end) as "u_100"
    from events group by 1""")
def pivot_distinct(t):
    return r.pivot(t.events, ["event_type"], "user_id", [50, 100], "count", ">=", "u_", then="user_id", otherwise=None, distinct=True)


@query("unpivot", [122], """
    select c_custkey, 'c_name' as field, c_name as val from customer union all select c_custkey, 'c_mktsegment', c_mktsegment from customer
    union all select c_custkey, 'positive', (c_acctbal > 0)::varchar from customer
    union all select c_custkey, 'maybe', nullif(c_mktsegment, 'BUILDING') from customer""")
def unpivot(t):
    df = t.customer.withColumn("positive", F.col("c_acctbal") > 0).withColumn("maybe", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return r.unpivot(df, ["c_custkey"], ["c_acctbal", "c_nationkey"], "string", "field", "val")


@query("surrogate_key", [123], """
    select o_orderkey, md5(o_orderkey::varchar || '-' || coalesce(nullif(o_orderstatus, 'P'), '_dbt_utils_surrogate_key_null_') || '-' || o_orderpriority) as key from orders""")
def surrogate_key(t):
    return t.orders.select("o_orderkey", c.surrogate_key("o_orderkey", F.expr("nullif(o_orderstatus, 'P')"), "o_orderpriority").alias("key"))


def _key64(text: str) -> int:
    """The signed 64-bit key of a text by the public xxHash library."""
    key = xxhash.xxh64_intdigest(text.encode(), 42)
    return key - (1 << 64) if key >> 63 else key


_KEYS64 = ", ".join(f"({n}, {r}, {_key64(f'{n}|{r}|')})" for n in range(25) for r in range(5))


@query("hash_key64", [124], f"""
    with k(n, r, key) as (values {_KEYS64})
    select n_nationkey, key::bigint as key, count(c_custkey) as customers from nation join k on n = n_nationkey and r = n_regionkey
    left join customer on c_nationkey = n_nationkey group by 1, 2""")
def hash_key64(t):
    key = c.hash_key64("n_nationkey", "n_regionkey", F.lit(None).cast("string"))
    per = t.customer.groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"))
    nations = t.nation.select("n_nationkey", key.alias("key"))
    return (nations.join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .select("n_nationkey", "key", F.coalesce("customers", F.lit(0)).alias("customers")))


@query("generate_series", [125], """
    with o as (select count(*) as n, c from (select o_custkey, count(*) as c from orders group by 1) group by c)
    select i as generated_number, coalesce(n, 0) as customers from generate_series(1, (select max(c) from o)) s(i) left join o on o.c = s.i""")
def generate_series(t):
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("c")).groupBy("c").agg(F.count("*").alias("customers"))
    top = per.agg(F.max("c")).first()[0]
    return (r.generate_series(t.spark, top).join(per, F.col("generated_number") == F.col("c"), "left")
            .select("generated_number", F.coalesce("customers", F.lit(0)).alias("customers")))


@query("date_spine", [126, 146], """
    with d as (select unnest(generate_series((select min(o_orderdate)::date from orders), (select max(o_orderdate)::date from orders) - 1, interval 1 day))::date as date_day)
    select date_day, count(o_orderkey) as orders from d left join orders on o_orderdate::date = date_day group by 1""")
def date_spine(t):
    per = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date_day")).agg(F.count("o_orderkey").alias("orders"))
    return (r.spine(r.span(t.orders, "o_orderdate")).join(per, "date_day", "left")
            .select("date_day", F.coalesce("orders", F.lit(0)).alias("orders")))


@query("base_dates_grains", [126, 146], """
    with b as (select min(ts)::date as s, max(ts)::date as e from events)
    select 'hour' as part, h as at from (select unnest(generate_series(s::timestamp, e::timestamp, interval 1 hour)) as h, e from b) where h < e
    union all select 'week', w from (select unnest(generate_series(s::timestamp, e::timestamp, interval 7 day)) as w, e from b) where w < e""")
def base_dates_grains(t):
    bounds = r.span(t.events, "ts")
    hours = r.spine(bounds, "hour").select(F.lit("hour").alias("part"), F.col("date_hour").alias("at"))
    weeks = r.spine(bounds, "week").select(F.lit("week").alias("part"), F.col("date_week").cast("timestamp_ntz").alias("at"))
    return hours.unionByName(weeks)


@query("width_bucket", [127], """
    select case when o_totalprice < 100000 then 0 when o_totalprice >= 400000 then 7
      else floor((o_totalprice - 100000) / 50000) + 1 end::bigint as bucket, count(*) as n from orders group by 1""")
def width_bucket(t):
    return t.orders.groupBy(c.width_bucket("o_totalprice", 100000, 400000, 6).alias("bucket")).agg(F.count("*").alias("n"))


_LAT, _LON = "(({k} * 37) % 1200) / 10.0 - 60", "(({k} * 91) % 3400) / 10.0 - 170"


@query("haversine_distance", [128], f"""
    with p as (select c_custkey, radians({_LAT.format(k='c_custkey')}) as a, radians({_LON.format(k='c_custkey')}) as o,
      radians({_LAT.format(k='c_nationkey')}) as na, radians({_LON.format(k='c_nationkey')}) as no_ from customer),
    d as (select c_custkey, 2 * 3961 * asin(sqrt(power(sin((na - a) / 2), 2) + cos(a) * cos(na) * power(sin((no_ - o) / 2), 2))) as mi from p)
    select c_custkey, round(mi, 6) as mi, round(mi * 1.60934, 6) as km from d""")
def haversine_distance(t):
    at = lambda e, k: F.expr(e.format(k=k)).cast("double")
    args = [at(_LAT, "c_custkey"), at(_LON, "c_custkey"), at(_LAT, "c_nationkey"), at(_LON, "c_nationkey")]
    return t.customer.select("c_custkey", F.round(c.haversine_distance(*args), 6).alias("mi"),
                             F.round(c.haversine_distance(*args, unit="km"), 6).alias("km"))


@query("safe_arithmetic", [129], """
    select doc_id, coalesce(quality, 0) + coalesce(toxic, 0) + n_chars as added, n_chars - coalesce(quality, 0) as taken,
      round(n_chars / nullif(toxic, 0), 6) as divided from documents left join labels using (doc_id)""")
def safe_arithmetic(t):
    df = t.documents.join(t.labels, "doc_id", "left")
    return df.select("doc_id", c.safe_add("quality", "toxic", "n_chars").alias("added"),
                     c.safe_subtract("n_chars", "quality").alias("taken"), F.round(c.safe_divide("n_chars", "toxic"), 6).alias("divided"))


@query("log_natural", [130], "select o_orderkey, round(ln(o_totalprice), 9) as ln_price from orders")
def log_natural(t):
    return t.orders.select("o_orderkey", F.round(c.log_natural("o_totalprice"), 9).alias("ln_price"))


@query("rand_uniform", [130], "select count(*) as n, true as in_range from orders")
def rand_uniform(t):
    u = t.orders.select(c.uniform(7).alias("u"))
    return u.agg(F.count("*").alias("n"), F.every((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_range"))


@query("md5_text", [131], "select l_orderkey, l_partkey, l_linenumber, md5(l_orderkey::varchar) as h from lineitem")
def md5_text(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", c.md5_text("l_orderkey").alias("h"))


_REST = "regexp_replace(url, 'android-app://|https?://', '', 'g')"


@query("url_parts", [132, 133, 134], f"""
    select page_id, regexp_extract({_REST}, '^[^/?]*') as host, nullif(regexp_extract({_REST}, '^[^/]*/([^?]*)', 1), '') as path,
      nullif(regexp_extract(url, 'page=([^&]*)', 1), '') as page, nullif(regexp_extract(url, 'utm_source=([^&]*)', 1), '') as source from pages""")
def url_parts(t):
    return t.pages.select("page_id", c.url_host("url").alias("host"), c.url_path("url").alias("path"),
                          c.url_parameter("url", "page").alias("page"), c.url_parameter("url", "utm_source").alias("source"))


@query("url_host_counts", [132], f"select regexp_extract({_REST}, '^[^/?]*') as host, count(*) as pages from pages group by 1")
def url_host_counts(t):
    return t.pages.groupBy(c.url_host("url").alias("host")).agg(F.count("*").alias("pages"))
