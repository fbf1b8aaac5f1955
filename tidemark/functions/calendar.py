"""Calendar expressions. Relative dates take an explicit `as_of`; None means today."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _day(x: str | Column) -> Column:
    return _c(x).cast("date")


def as_of_date(as_of: str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of.cast("date")


def day_of_week(d: str | Column, iso: bool = False) -> Column:
    """Sunday = 1, or Monday = 1 when iso."""
    return F.weekday(_day(d)) + 1 if iso else F.dayofweek(_day(d))


def day_name(d: str | Column, short: bool = True) -> Column:
    return F.date_format(_day(d), "E" if short else "EEEE")


def month_name(d: str | Column, short: bool = True) -> Column:
    return F.date_format(_day(d), "MMM" if short else "MMMM")


def day_of_month(d: str | Column) -> Column:
    return F.dayofmonth(_day(d))


def day_of_year(d: str | Column) -> Column:
    return F.dayofyear(_day(d))


def date_part(part: str, d: str | Column) -> Column:
    return F.extract(F.lit(part), _c(d)).cast("int")


def week_start(d: str | Column) -> Column:
    """The Sunday on or before the date."""
    return F.date_sub(_day(d), F.dayofweek(_day(d)) - 1)


def week_end(d: str | Column) -> Column:
    return F.date_add(week_start(d), 6)


def week_of_year(d: str | Column) -> Column:
    """Seven-day blocks counted from January 1st."""
    return F.ceil(F.dayofyear(_day(d)) / 7).cast("int")


def iso_week_start(d: str | Column) -> Column:
    return F.date_sub(_day(d), F.weekday(_day(d)))


def iso_week_end(d: str | Column) -> Column:
    return F.date_add(iso_week_start(d), 6)


def iso_week_of_year(d: str | Column) -> Column:
    return F.weekofyear(_day(d))


def quarter_end(d: str | Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(_day(d), "quarter"), 3), 1)


def year_end(d: str | Column) -> Column:
    return F.date_sub(F.add_months(F.trunc(_day(d), "year"), 12), 1)


def n_days_ago(n: int, as_of: str | Column | None = None) -> Column:
    return F.date_sub(as_of_date(as_of), n)


def n_days_away(n: int, as_of: str | Column | None = None) -> Column:
    return n_days_ago(-n, as_of)


def n_weeks_ago(n: int, as_of: str | Column | None = None) -> Column:
    """Monday of the week n weeks back."""
    return F.date_sub(iso_week_start(as_of_date(as_of)), 7 * n)


def n_weeks_away(n: int, as_of: str | Column | None = None) -> Column:
    return n_weeks_ago(-n, as_of)


def n_months_ago(n: int, as_of: str | Column | None = None) -> Column:
    """First of the month n months back."""
    return F.add_months(F.trunc(as_of_date(as_of), "month"), -n)


def n_months_away(n: int, as_of: str | Column | None = None) -> Column:
    return n_months_ago(-n, as_of)


def today(as_of=None) -> Column:
    return as_of_date(as_of)


def yesterday(as_of=None) -> Column:
    return n_days_ago(1, as_of)


def tomorrow(as_of=None) -> Column:
    return n_days_away(1, as_of)


def last_week(as_of=None) -> Column:
    return n_weeks_ago(1, as_of)


def next_week(as_of=None) -> Column:
    return n_weeks_away(1, as_of)


def last_month(as_of=None) -> Column:
    return n_months_ago(1, as_of)


def next_month(as_of=None) -> Column:
    return n_months_away(1, as_of)


def last_month_number(as_of=None) -> Column:
    return F.month(last_month(as_of))


def last_month_name(short: bool = True, as_of=None) -> Column:
    return month_name(last_month(as_of), short)


def next_month_number(as_of=None) -> Column:
    return F.month(next_month(as_of))


def next_month_name(short: bool = True, as_of=None) -> Column:
    return month_name(next_month(as_of), short)


def periods_since(d: str | Column, part: str, as_of: str | Column) -> Column:
    """Period boundaries crossed between the date and `as_of`."""
    a, b = _c(d).cast("timestamp"), (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    day = F.datediff(b.cast("date"), a.cast("date"))
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    hour = F.floor(F.unix_timestamp(b) / 3600) - F.floor(F.unix_timestamp(a) / 3600)
    weeks = F.datediff(iso_week_start(b), iso_week_start(a)) / 7
    return {"hour": hour, "day": day, "week": weeks, "month": months, "year": F.year(b) - F.year(a)}[part].cast("bigint")


def round_timestamp(t: str | Column) -> Column:
    """Nearest day."""
    return F.date_trunc("day", _c(t).cast("timestamp") + F.expr("interval 12 hours")).cast("timestamp_ntz")


def convert_timezone(t: str | Column, target: str, source: str = "UTC") -> Column:
    """Wall clock of one zone as wall clock of another."""
    return F.convert_timezone(F.lit(source), F.lit(target), _c(t).cast("timestamp_ntz"))


def from_unixtimestamp(epochs: str | Column, unit: str = "seconds") -> Column:
    e = _c(epochs)
    maker = {"seconds": F.timestamp_seconds, "milliseconds": F.timestamp_millis, "microseconds": F.timestamp_micros}
    if unit not in maker:
        raise ValueError(f"unknown unit {unit!r}")
    return maker[unit](e).cast("timestamp_ntz")


def to_unixtimestamp(t: str | Column) -> Column:
    return F.unix_timestamp(_c(t).cast("timestamp"))


def fiscal_year_end(year: Column, year_end_month: int, week_start_day: int) -> Column:
    """Last day of the retail year that closes in a calendar year.

    Weeks begin on `week_start_day` (Sunday = 1). The year ends with the week
    end nearest the closing month's end: exactly one of the seven days from
    three before it to three after it ends a week.
    """
    month_end = F.last_day(F.make_date(year, F.lit(year_end_month), F.lit(1)))
    return F.date_add(month_end, F.pmod(9 + week_start_day - F.dayofweek(month_end), F.lit(7)) - 3)


def with_fiscal_fields(df: DataFrame, d: str, year_end_month: int = 12, week_start_day: int = 1,
                       shift_year: int = 1) -> DataFrame:
    """Add the fiscal columns of a date, computed row by row without a calendar table.

    Each step is its own projection, so that an expression used several times
    is evaluated once.
    """
    closes = lambda year: fiscal_year_end(year, year_end_month, week_start_day)
    day, year = F.col("_day"), F.year("_day")
    out = df.withColumn("_day", _day(d))
    # a year may close a few days into the next January or before December ends
    out = out.withColumn("_closing", F.when(day <= closes(year - 1), year - 1).when(day <= closes(year), year)
                         .otherwise(year + 1))
    out = out.withColumns({"fiscal_year_start_date": F.date_add(closes(F.col("_closing") - 1), 1),
                           "fiscal_year_end_date": closes(F.col("_closing"))})
    week = (F.floor(F.datediff("_day", "fiscal_year_start_date") / 7) + 1).cast("int")
    out = out.withColumn("fiscal_week_of_year", week)
    first, n = F.col("fiscal_year_start_date"), F.col("fiscal_week_of_year")
    return out.withColumns({"fiscal_year_number": (F.col("_closing") - shift_year).cast("int"),
                            "week_start_date": F.date_add(first, (n - 1) * 7),
                            "week_end_date": F.date_add(first, n * 7 - 1)}).drop("_day", "_closing")


# First week (from 0) of the three periods of a 13-week quarter.
PERIOD_STARTS = (0, 4, 9)


def fiscal_period_fields(week: str | Column) -> dict[str, Column]:
    """4-5-4 quarter and period of a fiscal week; week 53 stays in the last period."""
    w = F.least(_c(week), F.lit(52)) - 1
    quarter = F.floor(w / 13).cast("int")
    inside = (w % 13).cast("int")
    period = reduce(lambda acc, s: acc + F.when(inside >= s, 1).otherwise(0), PERIOD_STARTS, F.lit(0))
    starts = F.array(*[F.lit(s) for s in PERIOD_STARTS])
    week_of_period = _c(week) - quarter * 13 - F.element_at(starts, period)
    return {"fiscal_week_of_period": week_of_period.cast("int"), "fiscal_period_number": (quarter * 3 + period).cast("int"),
            "fiscal_quarter_number": (quarter + 1).cast("int"), "fiscal_period_of_quarter": period.cast("int")}
