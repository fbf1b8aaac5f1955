"""Calendar and fiscal operators over the dates of the given tables."""

from pyspark.sql import functions as F

from tidemark.functions import calendar as c
from tidemark.operators import calendars as k, reshape as r

from .registry import query

_DAYS = """select unnest(generate_series((select min(o_orderdate)::date from orders), (select max(o_orderdate)::date from orders), interval 1 day))::date as date_day"""


def _order_days(t):
    return r.spine(r.span(t.orders, "o_orderdate"), inclusive=True)


def _sql_calendar(x, prefix=""):
    return f"""({x} - extract(dow from {x})::int)::date as {prefix}week_start_date, ({x} - extract(dow from {x})::int + 6)::date as {prefix}week_end_date,
      ceil(dayofyear({x}) / 7.0)::int as {prefix}week_of_year, date_trunc('week', {x})::date as {prefix}iso_week_start_date,
      (date_trunc('week', {x})::date + 6) as {prefix}iso_week_end_date, weekofyear({x})::int as {prefix}iso_week_of_year"""


@query("date_dimension", [147], f"""
    with d as ({_DAYS}), p as (select date_day, (date_day - interval 1 year)::date as py, date_day - 364 as pa from d)
    select date_day, date_day - 1 as prior_date_day, date_day + 1 as next_date_day, py as prior_year_date_day, pa as prior_year_over_year_date_day,
      extract(dow from date_day)::int + 1 as day_of_week, isodow(date_day)::int as day_of_week_iso, dayname(date_day) as day_of_week_name,
      substr(dayname(date_day), 1, 3) as day_of_week_name_short, day(date_day)::int as day_of_month, dayofyear(date_day)::int as day_of_year,
      {_sql_calendar('date_day')}, {_sql_calendar('pa', 'prior_year_')},
      date_trunc('month', date_day)::date as month_start_date, last_day(date_day) as month_end_date,
      date_trunc('month', py)::date as prior_year_month_start_date, last_day(py) as prior_year_month_end_date,
      month(date_day)::int as month_of_year, monthname(date_day) as month_name, substr(monthname(date_day), 1, 3) as month_name_short,
      quarter(date_day)::int as quarter_of_year, date_trunc('quarter', date_day)::date as quarter_start_date,
      (date_trunc('quarter', date_day) + interval 3 month - interval 1 day)::date as quarter_end_date,
      year(date_day)::int as year_number, date_trunc('year', date_day)::date as year_start_date, (date_trunc('year', date_day) + interval 1 year - interval 1 day)::date as year_end_date
    from p""")
def date_dimension(t):
    return k.date_dimension(_order_days(t))


def _fiscal_sql(month, start_dow, shift, days=None):
    """Oracle by search: list week ends per closing year, keep the nearest, pair neighbours."""
    return f"""d as ({days or _DAYS}), ws as (select date_day as s, date_day + 6 as e from d where extract(dow from date_day)::int + 1 = {start_dow}),
      ends as (select year(s) as y, arg_min(e, abs(e - last_day(make_date(year(s), {month}, 1)))) as fe from ws where month(s) = {month} group by 1),
      yrs as (select (y - {shift})::int as fiscal_year_number, lag(fe) over (order by fe) + 1 as fiscal_year_start_date, fe as fiscal_year_end_date from ends),
      fy as (select date_day, fiscal_year_number, fiscal_year_start_date, fiscal_year_end_date, s as week_start_date, e as week_end_date,
        (dense_rank() over (partition by fiscal_year_number order by s))::int as fiscal_week_of_year
        from d join yrs on date_day between fiscal_year_start_date and fiscal_year_end_date join ws on date_day between s and e)"""


@query("fiscal_year_dates", [148], f"with {_fiscal_sql(1, 1, 1)} select * from fy")
def fiscal_year_dates(t):
    return k.fiscal_year_dates(_order_days(t), 1, 1, 1)


@query("fiscal_year_dates_december", [148], f"with {_fiscal_sql(12, 2, 0)} select * from fy")
def fiscal_year_dates_december(t):
    return k.fiscal_year_dates(_order_days(t), 12, 2, 0)


@query("fiscal_periods", [149], f"""
    with {_fiscal_sql(1, 1, 1)}, lay as (select *, case when fiscal_week_of_year > 39 then 4 when fiscal_week_of_year > 26 then 3 when fiscal_week_of_year > 13 then 2 else 1 end as fiscal_quarter_number from fy),
    per as (select *, case when fiscal_week_of_year - (fiscal_quarter_number - 1) * 13 <= 4 then 1 when fiscal_week_of_year - (fiscal_quarter_number - 1) * 13 <= 9 then 2 else 3 end as fiscal_period_of_quarter from lay)
    select date_day, fiscal_year_number, week_start_date, week_end_date, fiscal_week_of_year,
      (dense_rank() over (partition by (fiscal_quarter_number - 1) * 3 + fiscal_period_of_quarter order by fiscal_week_of_year))::int as fiscal_week_of_period,
      ((fiscal_quarter_number - 1) * 3 + fiscal_period_of_quarter)::int as fiscal_period_number, fiscal_quarter_number, fiscal_period_of_quarter from per""")
def fiscal_periods(t):
    return k.fiscal_periods(_order_days(t), 1, 1, 1)


@query("fiscal_sales", [71, 148, 149], f"""
    with {_fiscal_sql(1, 1, 1)} select fiscal_year_number, fiscal_week_of_year, count(*) as orders, round(sum(o_totalprice), 2) as total
    from orders join fy on o_orderdate::date = date_day group by 1, 2""")
def fiscal_sales(t):
    # orders shrink to one row per day before they meet the calendar
    per_day = (t.orders.groupBy(F.col("o_orderdate").cast("date").alias("date_day"))
               .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v")))
    return (k.fiscal_year_dates(_order_days(t), 1, 1, 1).join(per_day, "date_day")
            .groupBy("fiscal_year_number", "fiscal_week_of_year")
            .agg(F.sum("n").alias("orders"), F.round(F.sum("v"), 2).alias("total")))


# a calendar that begins and ends well outside the orders, so every order lies in a whole fiscal year
_WIDE_DAYS = """select unnest(generate_series((select min(o_orderdate)::date - 800 from orders)::timestamp,
    (select max(o_orderdate)::date + 800 from orders)::timestamp, interval 1 day))::date as date_day"""


@query("fiscal_year_of_orders", [148], f"""
    with {_fiscal_sql(1, 1, 1, _WIDE_DAYS)} select fiscal_year_number, count(*) as orders from orders join fy on o_orderdate::date = date_day group by 1""")
def fiscal_year_of_orders(t):
    # the fiscal year is also a row-wise expression that needs no calendar
    df = c.with_fiscal_fields(t.orders.select("o_orderdate"), "o_orderdate", 1, 1, 1)
    return df.groupBy("fiscal_year_number").agg(F.count("*").alias("orders"))


@query("day_names", [150, 151], """
    select extract(dow from o_orderdate)::int + 1 as dow, isodow(o_orderdate)::int as iso_dow, dayname(o_orderdate) as name, substr(dayname(o_orderdate), 1, 3) as short,
      monthname(o_orderdate) as month, count(*) as n, max(day(o_orderdate))::int as last_dom, max(dayofyear(o_orderdate))::int as last_doy, max(extract(quarter from o_orderdate))::int as last_q
    from orders group by 1, 2, 3, 4, 5""")
def day_names(t):
    d = "o_orderdate"
    return (t.orders.groupBy(c.day_of_week(d).alias("dow"), c.day_of_week(d, True).alias("iso_dow"), c.day_name(d, False).alias("name"),
                             c.day_name(d).alias("short"), c.month_name(d, False).alias("month"))
            .agg(F.count("*").alias("n"), F.max(c.day_of_month(d)).alias("last_dom"), F.max(c.day_of_year(d)).alias("last_doy"),
                 F.max(c.date_part("quarter", d)).alias("last_q")))


@query("week_functions", [152, 153], f"select o_orderkey, {_sql_calendar('o_orderdate::date')} from orders")
def week_functions(t):
    d = "o_orderdate"
    return t.orders.select("o_orderkey", c.week_start(d).alias("week_start_date"), c.week_end(d).alias("week_end_date"),
                           c.week_of_year(d).alias("week_of_year"), c.iso_week_start(d).alias("iso_week_start_date"),
                           c.iso_week_end(d).alias("iso_week_end_date"), c.iso_week_of_year(d).alias("iso_week_of_year"))


@query("relative_dates", [154], """
    with d as (select o_orderkey, o_orderdate::date as d from orders)
    select o_orderkey, d - 10 as days_ago, d + 4 as days_away, date_trunc('week', d)::date - 14 as weeks_ago, date_trunc('week', d)::date + 21 as weeks_away,
      (date_trunc('month', d) - interval 2 month)::date as months_ago, (date_trunc('month', d) + interval 5 month)::date as months_away,
      d as today, d - 1 as yesterday, d + 1 as tomorrow, date_trunc('week', d)::date - 7 as last_week, date_trunc('week', d)::date + 7 as next_week,
      month(date_trunc('month', d) - interval 1 month)::int as last_month_number, monthname(date_trunc('month', d) - interval 1 month) as last_month_name,
      month(date_trunc('month', d) + interval 1 month)::int as next_month_number, substr(monthname(date_trunc('month', d) + interval 1 month), 1, 3) as next_month_name from d""")
def relative_dates(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", c.n_days_ago(10, d).alias("days_ago"), c.n_days_away(4, d).alias("days_away"), c.n_weeks_ago(2, d).alias("weeks_ago"),
        c.n_weeks_away(3, d).alias("weeks_away"), c.n_months_ago(2, d).alias("months_ago"), c.n_months_away(5, d).alias("months_away"),
        c.today(d).alias("today"), c.yesterday(d).alias("yesterday"), c.tomorrow(d).alias("tomorrow"), c.last_week(d).alias("last_week"),
        c.next_week(d).alias("next_week"), c.last_month_number(d).alias("last_month_number"), c.last_month_name(False, d).alias("last_month_name"),
        c.next_month_number(d).alias("next_month_number"), c.next_month_name(True, d).alias("next_month_name"))


@query("periods_since_round", [155], """
    select event_id, date_diff('hour', ts, timestamp '2024-02-03 05:06:07') as hours, date_diff('day', ts, timestamp '2024-02-03 05:06:07') as days,
      date_diff('month', ts, timestamp '2024-02-03 05:06:07') as months, ((date '2024-01-29' - date_trunc('week', ts)::date) / 7)::bigint as weeks,
      date_trunc('day', ts + interval 12 hour)::timestamp as rounded from events""")
def periods_since_round(t):
    now = "2024-02-03 05:06:07"
    return t.events.select("event_id", c.periods_since("ts", "hour", now).alias("hours"), c.periods_since("ts", "day", now).alias("days"),
                           c.periods_since("ts", "month", now).alias("months"), c.periods_since("ts", "week", now).alias("weeks"),
                           c.round_timestamp("ts").alias("rounded"))


@query("convert_timezone", [156], """
    select event_id, ts - interval 8 hour as los_angeles, ts + interval 330 minute as kolkata from events""")
def convert_timezone(t):
    # January lies outside daylight saving time, so the offsets are fixed
    return t.events.select("event_id", c.convert_timezone("ts", "America/Los_Angeles").alias("los_angeles"),
                           c.convert_timezone("ts", "Asia/Kolkata").alias("kolkata"))


@query("unix_timestamps", [157], """
    select event_id, epoch(date_trunc('second', ts))::bigint as epoch, date_trunc('second', ts) as from_seconds, date_trunc('millisecond', ts) as from_millis, ts as from_micros from events""")
def unix_timestamps(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", c.to_unixtimestamp("ts").alias("epoch"), c.from_unixtimestamp(c.to_unixtimestamp("ts")).alias("from_seconds"),
                           c.from_unixtimestamp(F.expr("unix_millis(cast(ts as timestamp))"), "milliseconds").alias("from_millis"),
                           c.from_unixtimestamp(micros, "microseconds").alias("from_micros"))
