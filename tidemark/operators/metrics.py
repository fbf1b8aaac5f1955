"""Metrics over measures: ratios, trailing windows, conversion, level of detail, alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shapes import period
from .filters import Filter
from .measures import Measure, aggregate
from .ordered import HOT_ROWS, running, same


def metric_query(df: DataFrame, dimensions: Sequence[str], measures: Sequence[Measure],
                 formulas: Mapping[str, str], keep_inputs: bool = False) -> DataFrame:
    """Simple, derived and ratio metrics: SQL formulas over aggregated measures."""
    out = aggregate(df, dimensions, measures)
    inputs = [m.name for m in measures] if keep_inputs else []
    return out.select(*dimensions, *inputs, *[F.expr(f).alias(n) for n, f in formulas.items()])


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """NULL instead of an error when the divisor is zero."""
    return F.try_divide(F.col(numerator) if isinstance(numerator, str) else numerator,
                        F.col(denominator) if isinstance(denominator, str) else denominator)


def _period_index(column: str, grain: str) -> Column:
    days = F.unix_date(F.col(column).cast("date"))
    months = F.year(column) * 12 + F.month(column)
    return {"day": days, "week": F.floor((days + 4) / 7), "month": months,
            "quarter": F.floor((months - 1) / 3), "year": F.year(column)}[grain].cast("bigint")


def cumulative_metric(df: DataFrame, time_column: str, grain: str, value: str, group_by: Sequence[str] = (),
                      window: int | None = None, name: str = "cumulative") -> DataFrame:
    """Total over the trailing `window` periods (missing periods count as empty), or from the start."""
    per = (df.groupBy(*group_by, period(time_column, grain).alias("time_period"))
           .agg(F.sum(F.expr(value)).alias("period_value")))
    if window is None:
        # `per` holds one row per group and period, so no group is long
        return running(per, group_by, ["time_period"], {name: ("sum", "period_value")}, short=True)
    w = (Window.partitionBy(*group_by).orderBy(_period_index("time_period", grain))
         .rangeBetween(-(window - 1), 0))
    return per.withColumn(name, F.sum("period_value").over(w))


def conversion_metric(events: DataFrame, user: str, time: str, kind: str, base: str, conversion: str,
                      window_seconds: int, group_by: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Base events, and those followed by a conversion of the same user within the window.

    Time is cut into buckets as long as the window. A conversion is listed in
    its own bucket and the one before, so each base event sees every candidate
    inside one (user, bucket) window: a busy user spreads over many buckets and
    no pairs are formed. Within a bucket of more than `hot_rows` events the
    walk goes by chunks, each of which is handed the nearest conversion ahead.
    """
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = window_seconds * 1_000_000
    rows = (events.filter(F.col(kind).isin(base, conversion))
            .select(user, F.col(kind).alias("_kind"), at.alias("_at"), *group_by)
            .withColumn("_bucket", F.floor(F.col("_at") / span)))
    is_base = F.col("_kind") == base
    listed = rows.withColumn("_b", F.explode(
        F.when(is_base, F.array("_bucket")).otherwise(F.array(F.col("_bucket"), F.col("_bucket") - 1))))
    # at one instant the base event sorts first, so a simultaneous conversion counts
    # read backwards, the nearest conversion ahead is a running minimum: one step per row
    listed = listed.withColumns({"_base": is_base, "_conversion": F.when(~is_base, F.col("_at"))})
    seen = running(listed, [user, "_b"], ["-_at", "_base"], {"_next": ("min", "_conversion")}, hot_rows).filter("_base")
    converted = F.coalesce(F.col("_next") - F.col("_at") <= span, F.lit(False))
    return (seen.groupBy(*group_by)
            .agg(F.count(F.lit(1)).alias("base_events"), F.count_if(converted).alias("converted_events"),
                 F.count_distinct(user).alias("base_users"),
                 F.count_distinct(F.when(converted, F.col(user))).alias("converted_users"))
            .withColumn("conversion_rate", ratio("converted_events", "base_events")))


def hierarchy_rollup(df: DataFrame, levels: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Subtotals of every prefix of the level path; `level` counts the levels in use.

    Exact order statistics have no partial form: for them each row is listed
    once per prefix.
    """
    n = len(levels)
    if any(m.ordered for m in measures):
        listed = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n))))
        listed = listed.withColumns({c: F.when(F.col("level") > i, F.col(c)) for i, c in enumerate(levels)})
        return aggregate(listed, [*levels, "level"], measures).select(*levels, *[m.name for m in measures], "level")
    used = F.lit(n) - sum((F.grouping(c).cast("int") for c in levels[1:]), F.grouping(levels[0]).cast("int"))
    return df.rollup(*levels).agg(*[m.to_column() for m in measures], used.alias("level"))


def pivot_with_subtotals(df: DataFrame, row: str, column: str, values: Sequence, measure: Measure) -> DataFrame:
    """Cross-tab of named column values with a row total and a grand total row."""
    cells = [replace(measure, name=f"{column}_{v}", filters=(*measure.filters, Filter(column, "=", v))) for v in values]
    total = replace(measure, name="total")
    if measure.ordered:
        listed = df.withColumn("is_total", F.explode(F.array(F.lit(0), F.lit(1))))
        return aggregate(listed.withColumn(row, F.when(F.col("is_total") == 0, F.col(row))), [row, "is_total"], [*cells, total])
    return df.rollup(row).agg(F.grouping(row).cast("int").alias("is_total"), *[c.to_column() for c in cells], total.to_column())


def lod_fixed(df: DataFrame, unfiltered: DataFrame, grain: Sequence[str], measure: Measure) -> DataFrame:
    """Attach an aggregate at a fixed grain of the unfiltered rows."""
    fixed = aggregate(unfiltered, grain, [measure])
    return (df.alias("l").join(fixed.alias("r"), same("l", "r", grain), "left")
            .select("l.*", F.col(f"r.`{measure.name}`")))


def lod_include(df: DataFrame, dimensions: Sequence[str], finer: Sequence[str], inner: Measure,
                outer: Measure) -> DataFrame:
    """Aggregate at a finer grain, then aggregate that to the dimensions."""
    return aggregate(aggregate(df, [*dimensions, *finer], [inner]), dimensions, [outer])


def lod_exclude(df: DataFrame, dimensions: Sequence[str], excluded: Sequence[str], measure: Measure,
                name: str = "excluded_total") -> DataFrame:
    """The measure per dimensions beside its value without the excluded ones."""
    detail = aggregate(df, dimensions, [measure])
    kept = [d for d in dimensions if d not in excluded]
    coarse = aggregate(df, kept, [Measure(name, measure.aggregation, measure.expression, measure.percentile,
                                          measure.filters)])
    if not kept:
        return detail.withColumn(name, coarse.scalar())
    return detail.alias("l").join(coarse.alias("r"), same("l", "r", kept), "left").select("l.*", f"r.{name}")


def daily_rollup(df: DataFrame, time_column: str, dimensions: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Per-day pre-aggregate, meant to be written and queried instead of the detail."""
    return aggregate(df.withColumn("day", period(time_column, "day")), ["day", *dimensions], measures)


_TESTS = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
          "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def alert_condition(column: str, op: str, threshold: float | tuple[float, float]) -> Column:
    """`outside` takes a (low, high) pair; other operators one number."""
    c = F.col(column)
    if op == "outside":
        return (c < threshold[0]) | (c > threshold[1])
    return _TESTS[op](c, threshold)


def kpi_alert(df: DataFrame, time_column: str, grain: str, measures: Sequence[Measure],
              conditions: Sequence[tuple[str, str, object]], mode: str = "and",
              group_by: Sequence[str] = ()) -> DataFrame:
    """Periods whose metric conditions hold.

    A condition on `<measure>_change` tests the percent change to the period
    row before it.
    """
    base = aggregate(df.withColumn("time_period", period(time_column, grain)), ["time_period", *group_by], measures)
    names = [m.name for m in measures]
    w = Window.partitionBy(*group_by).orderBy("time_period")  # one row per group and period
    out = base.withColumns({f"_p_{n}": F.lag(n).over(w) for n in names})
    for n in names:
        out = out.withColumn(f"{n}_change", ratio((F.col(n) - F.col(f"_p_{n}")) * 100, F.col(f"_p_{n}"))).drop(f"_p_{n}")
    tests = [F.coalesce(alert_condition(*c), F.lit(False)) for c in conditions]
    hit = tests[0]
    for test in tests[1:]:
        hit = (hit & test) if mode == "and" else (hit | test)
    return out.filter(hit)


def column_values(df: DataFrame, column: str, max_records: int | None = None, where: str | None = None,
                  by_count: bool = True) -> DataFrame:
    """Distinct values with counts, most common first (value breaks ties)."""
    out = (df.filter(where) if where else df).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc(column)] if by_count else [F.asc(column)]
    out = out.orderBy(*order)
    return out.limit(max_records) if max_records is not None else out


def single_value(df: DataFrame):
    """First cell of a query result."""
    row = df.select(df.columns[0]).first()
    return None if row is None else row[0]


def results_as_dict(df: DataFrame, max_rows: int = 10_000) -> dict[str, list]:
    """Column lists of a small result; refuses anything larger than `max_rows`."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows; write it to a table instead")
    return {c: [r[c] for r in rows] for c in df.columns}
