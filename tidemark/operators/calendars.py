"""Calendar tables built over a column of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import calendar as c


def date_dimension(days: DataFrame, day: str = "date_day") -> DataFrame:
    """Calendar attributes of each day, with last year's date and its weekday-aligned twin."""
    d = F.col(day).cast("date")
    prior, aligned = F.add_months(d, -12), F.date_sub(d, 364)
    columns = {
        "date_day": d, "prior_date_day": c.yesterday(d), "next_date_day": c.tomorrow(d),
        "prior_year_date_day": prior, "prior_year_over_year_date_day": aligned,
        "day_of_week": c.day_of_week(d), "day_of_week_iso": c.day_of_week(d, iso=True),
        "day_of_week_name": c.day_name(d, short=False), "day_of_week_name_short": c.day_name(d),
        "day_of_month": c.day_of_month(d), "day_of_year": c.day_of_year(d),
    }
    for prefix, x in (("", d), ("prior_year_", aligned)):
        columns |= {
            f"{prefix}week_start_date": c.week_start(x), f"{prefix}week_end_date": c.week_end(x),
            f"{prefix}week_of_year": c.week_of_year(x), f"{prefix}iso_week_start_date": c.iso_week_start(x),
            f"{prefix}iso_week_end_date": c.iso_week_end(x), f"{prefix}iso_week_of_year": c.iso_week_of_year(x)}
    for prefix, x in (("", d), ("prior_year_", prior)):
        columns |= {f"{prefix}month_start_date": F.trunc(x, "month"), f"{prefix}month_end_date": F.last_day(x)}
    columns |= {
        "month_of_year": F.month(d), "month_name": c.month_name(d, short=False), "month_name_short": c.month_name(d),
        "quarter_of_year": F.quarter(d), "quarter_start_date": F.trunc(d, "quarter"), "quarter_end_date": c.quarter_end(d),
        "year_number": F.year(d), "year_start_date": F.trunc(d, "year"), "year_end_date": c.year_end(d)}
    return days.select(*[x.alias(n) for n, x in columns.items()])


def fiscal_year_dates(days: DataFrame, year_end_month: int = 12, week_start_day: int = 1, shift_year: int = 1,
                      day: str = "date_day", only_full_years: bool = True) -> DataFrame:
    """Days with their retail fiscal year and week.

    `only_full_years` keeps the fiscal years whose closing weeks (this year's
    and last year's) both begin inside the calendar given.
    """
    out = c.with_fiscal_fields(days, day, year_end_month, week_start_day, shift_year)
    if only_full_years:
        edges = days.agg(F.struct(F.min(F.col(day).cast("date")).alias("lo"), F.max(F.col(day).cast("date")).alias("hi"))).scalar()
        out = (out.withColumn("_e", edges)
               .filter((F.date_sub("fiscal_year_start_date", 7) >= F.col("_e.lo"))
                       & (F.date_sub("fiscal_year_end_date", 6) <= F.col("_e.hi"))).drop("_e"))
    return out.select(F.col(day).cast("date").alias("date_day"), "fiscal_year_number", "fiscal_year_start_date",
                      "fiscal_year_end_date", "week_start_date", "week_end_date", "fiscal_week_of_year")


def fiscal_periods(days: DataFrame, year_end_month: int = 12, week_start_day: int = 1, shift_year: int = 1,
                   day: str = "date_day") -> DataFrame:
    """Fiscal year dates with their 4-5-4 quarter, period and week of period."""
    base = fiscal_year_dates(days, year_end_month, week_start_day, shift_year, day)
    fields = c.fiscal_period_fields("fiscal_week_of_year")
    return base.select("date_day", "fiscal_year_number", "week_start_date", "week_end_date", "fiscal_week_of_year",
                       *[x.alias(n) for n, x in fields.items()])
