"""Scalar functions offered to SQL users."""

from pyspark.sql import functions as F

from tidemark.functions import columns as c

from .registry import query


@query("string_functions", [136], """
    select c_custkey, concat(c_name, '/', c_mktsegment) as joined, upper(c_mktsegment) as up, lower(c_name) as low, trim('  ' || c_name || ' ') as trimmed,
      length(c_name)::int as len, substring(c_name, 3, 5) as sub, replace(c_name, '#', '-') as rep, split_part(c_name, '#', 2) as part2 from customer""")
def string_functions(t):
    return t.customer.selectExpr(
        "c_custkey", "concat(c_name, '/', c_mktsegment) as joined", "upper(c_mktsegment) as up", "lower(c_name) as low",
        "trim('  ' || c_name || ' ') as trimmed", "length(c_name) as len", "substring(c_name, 3, 5) as sub",
        "replace(c_name, '#', '-') as rep", "split_part(c_name, '#', 2) as part2")


@query("math_functions", [137], """
    select s_suppkey, abs(s_acctbal) as a, round(s_acctbal / 3, 6) as r, floor(s_acctbal)::bigint as f, ceil(s_acctbal)::bigint as c, round(power(s_nationkey, 2), 6) as p,
      round(sqrt(abs(s_acctbal)), 9) as q, round(ln(abs(s_acctbal) + 1), 9) as l, s_suppkey % 7 as m from supplier""")
def math_functions(t):
    return t.supplier.selectExpr(
        "s_suppkey", "abs(s_acctbal) as a", "round(s_acctbal / 3, 6) as r", "floor(s_acctbal) as f", "ceil(s_acctbal) as c",
        "power(s_nationkey, 2) as p", "round(sqrt(abs(s_acctbal)), 9) as q", "round(ln(abs(s_acctbal) + 1), 9) as l", "s_suppkey % 7 as m")


@query("date_parts", [138], """
    select event_id, extract(year from ts)::int as y, extract(month from ts)::int as mo, date_part('day', ts)::int as d, extract(hour from ts)::int as h,
      date_trunc('hour', ts) as hour_start, date_trunc('month', ts)::date as month_start, date_part('quarter', ts)::int as q from events""")
def date_parts(t):
    return t.events.selectExpr("event_id", "extract(year from ts) as y", "extract(month from ts) as mo", "date_part('day', ts) as d",
                               "extract(hour from ts) as h", "date_trunc('hour', ts) as hour_start",
                               "cast(date_trunc('month', ts) as date) as month_start", "date_part('quarter', ts) as q")


@query("date_arithmetic", [139], """
    select o_orderkey, o_orderdate + interval 3 month as plus_months, (o_orderdate::date + 10) as plus_days, date_diff('day', o_orderdate::date, date '2002-01-01') as days_left,
      date_sub('month', o_orderdate, timestamp '2002-01-01') as months_left, date_sub('hour', o_orderdate, timestamp '2002-01-01') as hours_left from orders""")
def date_arithmetic(t):
    return t.orders.selectExpr(
        "o_orderkey", "o_orderdate + interval 3 month as plus_months", "date_add(o_orderdate, 10) as plus_days",
        "cast(datediff(date'2002-01-01', o_orderdate) as bigint) as days_left",
        "timestampdiff(month, o_orderdate, timestamp'2002-01-01') as months_left", "timestampdiff(hour, o_orderdate, timestamp'2002-01-01') as hours_left")


@query("to_char_to_date", [140], """
    select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') as text, strftime(o_orderdate, '%d %b %Y') as short, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::date as back from orders""")
def to_char_to_date(t):
    return t.orders.select("o_orderkey", c.to_char("o_orderdate", "YYYY/MM/DD HH24:MI").alias("text"),
                           c.to_char("o_orderdate", "DD Mon YYYY").alias("short"),
                           c.to_date(c.to_char("o_orderdate", "DD.MM.YYYY"), "DD.MM.YYYY").alias("back"))


@query("clock_functions", [141], "select count(*) as n, true as past from orders where o_orderdate < now()")
def clock_functions(t):
    df = t.orders.filter("o_orderdate < current_timestamp()")
    return df.agg(F.count("*").alias("n"), F.every(F.expr("cast(o_orderdate as date) <= current_date() and o_orderdate <= now()")).alias("past"))


@query("conditional_functions", [142], """
    select l_orderkey, l_partkey, l_linenumber, case l_returnflag when 'R' then 'back' when 'A' then 'ok' else 'new' end as state,
      if(l_discount > 0.05, 'deal', 'list') as price_kind, coalesce(nullif(l_tax, 0), -1) as tax from lineitem""")
def conditional_functions(t):
    return t.lineitem.selectExpr("l_orderkey", "l_partkey", "l_linenumber", "case l_returnflag when 'R' then 'back' when 'A' then 'ok' else 'new' end as state",
                                 "if(l_discount > 0.05D, 'deal', 'list') as price_kind", "coalesce(nullif(l_tax, 0D), -1D) as tax")


@query("warehouse_time_functions", [143], """
    select isodow(ts)::int as dow, extract(hour from ts)::int as hour, (ts::date - extract(dow from ts)::int)::date as week, count(*) as n from events group by 1, 2, 3""")
def warehouse_time_functions(t):
    from tidemark.plans.shapes import period

    return t.events.groupBy(c.day_of_week_monday("ts").alias("dow"), F.hour("ts").alias("hour"), period("ts", "week").alias("week")).agg(F.count("*").alias("n"))


@query("json_property", [144], "select (props->>'$.k')::int as k, count(*) as n, round(sum(value), 2) as total from events group by 1")
def json_property(t):
    return (t.events.groupBy(c.json_property("props", "k", "int").alias("k"))
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")))


@query("regexp_instr", [145], r"""
    select p_partkey, case when regexp_matches(p_name, '[aeiou]') then length(regexp_extract(p_name, '^[^aeiou]*')) + 1 else 0 end::int as first_vowel,
      case when regexp_matches(p_name, '[aeiou][^aeiou]*[aeiou]') then length(regexp_extract(p_name, '^[^aeiou]*[aeiou][^aeiou]*')) + 1 else 0 end::int as second_vowel,
      case when regexp_matches(p_name, '(?i) [A-M]') then length(regexp_extract(p_name, '^[^ ]*')) + 1 else 0 end::int as space_at from part""")
def regexp_instr(t):
    return t.part.select("p_partkey", c.regexp_position("p_name", "[aeiou]").alias("first_vowel"),
                         c.regexp_position("p_name", "[aeiou]", occurrence=2).alias("second_vowel"),
                         c.regexp_position("p_name", " [A-M]", flags="i").alias("space_at"))


@query("format_measure", [256], """
    select s_suppkey, format('{:t,}', round(s_acctbal)::bigint) as unit_text, (case when s_acctbal < 0 then '-' else '' end) || '$' || format('{:t,}', trunc(abs(s_acctbal))::bigint) as money,
      printf('%.1f%%', s_nationkey * 100.0) as pct, case when s_suppkey * 1000 >= 1000000 then printf('%.1fM', s_suppkey * 1000 / 1e6) when s_suppkey >= 1 then printf('%.1fK', s_suppkey * 1.0) else '0.0' end as short from supplier""".replace("{:t,}", "{:,}"))
def format_measure(t):
    whole = F.expr("cast(abs(s_acctbal) as bigint) * if(s_acctbal < 0, -1, 1)")
    return t.supplier.select("s_suppkey", c.format_measure(F.round("s_acctbal")).alias("unit_text"), c.format_measure(whole, "currency").alias("money"),
                             F.replace(c.format_measure("s_nationkey", "percent", 1), F.lit(","), F.lit("")).alias("pct"),
                             c.format_measure(F.col("s_suppkey") * 1000, "compact", 1).alias("short"))


@query("sql_dialect_functions", [2, 143], """
    select date_trunc('month', ts)::date as month, (ts::date - extract(dow from ts)::int)::date as week, isodow(ts)::int as dow, hour(ts)::int as hour, count(*) as n,
      min(date_trunc('hour', ts)) as first_hour from events group by 1, 2, 3, 4""")
def sql_dialect_functions(t):
    from tidemark.functions.sql import register_dialect
    from tidemark.sources.readers import read_query

    register_dialect(t.spark)
    return read_query(t.spark, """
        select toStartOfMonth(ts) as month, toStartOfWeek(ts) as week, toDayOfWeek(ts) as dow, toHour(ts) as hour, count(*) as n, min(toStartOfHour(ts)) as first_hour
        from {e} group by 1, 2, 3, 4""", e=t.events)
