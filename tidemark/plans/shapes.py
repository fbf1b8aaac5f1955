"""Typed query shapes over one frame: aggregation, comparison, trend, top-N and relatives."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filter, conjunction, time_range
from ..operators.measures import Measure, aggregate
from .semantic import page


def period(column: str | Column, grain: str) -> Column:
    """Start of the period holding a date or timestamp; weeks start on Sunday."""
    c = F.expr(column) if isinstance(column, str) else column
    if grain == "hour":
        return F.date_trunc("hour", c).cast("timestamp_ntz")
    day = c.cast("date")
    if grain == "day":
        return day
    if grain == "week":
        return F.date_sub(day, F.dayofweek(day) - 1)
    if grain in ("month", "quarter", "year"):
        return F.trunc(day, grain)
    raise ValueError(f"unknown grain {grain!r}")


def aggregation_query(df: DataFrame, dimensions: Sequence[str], measures: Sequence[Measure],
                      filters: Sequence[Filter] = (), having: Sequence[Filter] = (),
                      order_by: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    out = aggregate(df.filter(conjunction(filters)), dimensions, measures)
    if having:
        out = out.filter(conjunction(having))
    return page(out, order_by, limit)


def drill_down(df: DataFrame, path: Sequence[str], chosen: dict[str, Any], measures: Sequence[Measure]) -> DataFrame:
    """Fix the chosen levels of a hierarchy and group by the next one."""
    done = [p for p in path if p in chosen]
    nxt = next(p for p in path if p not in chosen)
    return aggregation_query(df, [*done, nxt], measures, [Filter(k, "=", v) for k, v in chosen.items()])


def comparison_query(df: DataFrame, dimension: str, values: Sequence[Any], measures: Sequence[Measure],
                     group_by: Sequence[str] = (), filters: Sequence[Filter] = ()) -> DataFrame:
    """One column per (measure, value) and the total over the compared values."""
    if len(values) < 2:
        raise ValueError("compare at least two values")
    kept = df.filter(F.col(dimension).isin(list(values))).filter(conjunction(filters))
    labels = [str(v).replace(" ", "_") for v in values]
    if len(set(labels)) < len(labels):  # as with "a b" and "a_b": the values themselves tell them apart
        labels = [str(v) for v in values]
    wide = [Measure(f"{m.name}_{label}", m.aggregation, m.expression, m.percentile,
                    (*m.filters, Filter(dimension, "=", v)), m.approximate)
            for v, label in zip(values, labels) for m in measures]
    total = [Measure(f"{m.name}_total", m.aggregation, m.expression, m.percentile, m.filters, m.approximate)
             for m in measures]
    return aggregate(kept, list(group_by), [*wide, *total])


def trend_query(df: DataFrame, time_column: str, grain: str, measures: Sequence[Measure],
                group_by: Sequence[str] = (), filters: Sequence[Filter] = (),
                date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    kept = df.filter(conjunction(filters)).filter(time_range(time_column, date_from, date_to))
    return aggregate(kept.withColumn("time_period", period(time_column, grain)),
                     ["time_period", *group_by], measures)


def top_n_query(df: DataFrame, dimension: str, measure: Measure, n: int = 10, ascending: bool = False,
                filters: Sequence[Filter] = (), extra: Sequence[Measure] = ()) -> DataFrame:
    """Groups ranked by a measure; the key breaks ties."""
    if n < 1:
        raise ValueError("n is at least 1")
    grouped = aggregate(df.filter(conjunction(filters)), [dimension], [measure, *extra])
    by = F.col(measure.name)
    return grouped.orderBy(by.asc() if ascending else by.desc(), F.col(dimension).asc()).limit(n)


def distribution_query(df: DataFrame, value: str, bins: int = 10, group_by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the observed range; the last bin includes the maximum."""
    v = F.expr(value).cast("double")
    bounds = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    placed = (df.select(*group_by, v.alias("_v")).filter(F.col("_v").isNotNull()).withColumn("_r", bounds)
              .withColumn("_w", (F.col("_r.hi") - F.col("_r.lo")) / bins))
    raw = F.floor((F.col("_v") - F.col("_r.lo")) / F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_w")))
    return (placed.withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("bigint") + 1)
            .groupBy(*group_by, "bin")
            .agg((F.min("_r.lo") + (F.col("bin") - 1) * F.min("_w")).alias("bin_start"),
                 (F.min("_r.lo") + F.col("bin") * F.min("_w")).alias("bin_end"),
                 F.count(F.lit(1)).alias("n")))


def correlation_query(df: DataFrame, x: str, y: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation with the least-squares line of y on x."""
    fx, fy = F.expr(x).cast("double"), F.expr(y).cast("double")
    return df.groupBy(*group_by).agg(
        F.count(F.when(fx.isNotNull() & fy.isNotNull(), 1)).alias("n"), F.corr(fx, fy).alias("correlation"),
        F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"))
