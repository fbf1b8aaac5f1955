"""Result shapes behind charts: statistics, hierarchies, flows, matrices, bins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shapes import distribution_query, period
from .filters import bucket_column
from .joins import same_period_join
from .measures import Measure, aggregate
from ..session import materialize
from .ordered import count_values, has_hot_group, percentiles_of_counts, running, same
from .reshape import pivot, span, spine

EMPTY_NODE = "∅"  # fixed value: label of a missing level


def _fenced(df: DataFrame, groups: Sequence[str], value: str, reach: float) -> DataFrame:
    """Distinct values with counts beside their group's quartiles and fences."""
    short = not has_hot_group(df, groups)
    counts = count_values(df, groups, value)
    counts = counts if short else materialize(counts, "counted")
    quartiles = percentiles_of_counts(counts, groups, {"q1": 0.25, "median": 0.5, "q3": 0.75}, short=short)
    step = (F.col("q3") - F.col("q1")) * reach
    fences = quartiles.withColumn("low", F.col("q1") - step).withColumn("high", F.col("q3") + step)
    return (counts.alias("l").join(fences.alias("r"), same("l", "r", groups), "inner")
            .select(*[F.col(f"l.{g}") for g in groups], F.col("l._v").alias("value"), F.col("l._n").alias("n"),
                    "q1", "median", "q3", "low", "high"))


def box_plot_stats(df: DataFrame, groups: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the extreme values inside the fences, and how many lie outside."""
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return (_fenced(df, groups, value, reach).groupBy(*groups)
            .agg(F.coalesce(F.min(F.when(inside, F.col("value"))), F.min("value")).alias("whisker_low"),
                 F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
                 F.coalesce(F.max(F.when(inside, F.col("value"))), F.max("value")).alias("whisker_high"),
                 F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers")))


def box_plot_outliers(df: DataFrame, groups: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Outlying values as rows (value, how often), never gathered into a list."""
    return (_fenced(df, groups, value, reach).filter(~F.col("value").between(F.col("low"), F.col("high")))
            .select(*groups, "value", "n"))


def hierarchy_tree(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """One row per node of the path tree: depth, path text, value. Missing levels get a label."""
    named = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(EMPTY_NODE)).alias(c) for c in levels],
                      F.expr(value).alias("_v"))
    depth = reduce(lambda a, b: a + b, [(1 - F.grouping(c)).cast("int") for c in levels])
    # concat_ws skips the levels that the rollup sets to NULL
    return (named.rollup(*levels).agg(depth.alias("depth"), F.coalesce(F.sum("_v"), F.lit(0)).alias("value"))
            .filter("depth > 0").select(F.concat_ws(" / ", *levels).alias("path"), "depth", "value"))


def flow_links(df: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Source to target totals; links need both names and a positive value."""
    total = df.groupBy(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target")).agg(
        F.sum(F.expr(value)).alias("value"))
    return total.filter("source <> '' and target <> '' and value > 0")


def _axis(df: DataFrame, column: str, limit: int) -> list:
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} values, too many for a chart axis")
    return sorted(r[0] for r in rows)


def heatmap_matrix(df: DataFrame, x: str, y: str, measure: Measure, max_y: int = 1000) -> DataFrame:
    """Every (x, y) cell, empty ones as 0. The y axis must fit a chart."""
    cells = aggregate(df, [x, y], [measure])
    ys = _axis(df, y, max_y)
    axis = F.array(*[F.lit(v) for v in ys])
    grid = df.select(x).filter(F.col(x).isNotNull()).distinct().withColumn(y, F.explode(axis))
    return grid.join(cells, [x, y], "left").fillna(0, [measure.name])


def funnel_steps(df: DataFrame, stage: str, order: Sequence[Any], measure: Measure) -> DataFrame:
    """Stage values in the given order with step and overall conversion."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(stage)).cast("int").alias("step")
    per = aggregate(df.filter(F.col(stage).isin(list(order))), [stage], [measure]).withColumn("step", place)
    # at most one row per listed stage from here on
    w = Window.orderBy("step")
    prev, first = F.lag(measure.name).over(w), F.first(measure.name).over(w)
    return per.select("step", stage, measure.name, F.try_divide(F.col(measure.name), prev).alias("step_conversion"),
                      F.try_divide(F.col(measure.name), first).alias("overall_conversion"))


def kpi_value(df: DataFrame, time_column: str, value: Column, current: tuple[str, str], previous: tuple[str, str],
              target: float | None = None) -> DataFrame:
    """One row: value now, value before, absolute and percent change, progress to a target.

    Ranges are half-open (start, end). `value` is an expression to be summed.
    """
    t = F.col(time_column)
    during = lambda r: (t >= F.lit(r[0]).cast("timestamp_ntz")) & (t < F.lit(r[1]).cast("timestamp_ntz"))
    out = (df.filter(during(current) | during(previous))
           .agg(F.sum(F.when(during(current), value)).alias("value"), F.sum(F.when(during(previous), value)).alias("previous")))
    diff = F.col("value") - F.col("previous")
    out = out.withColumn("change", diff).withColumn("percent_change", F.try_divide(diff * 100, F.col("previous")))
    return out.withColumn("of_target", F.col("value") / target) if target else out


def gauge_zone(df: DataFrame, value: str, zones: Sequence[tuple[float, str]], last: str) -> DataFrame:
    """Zone of each value: label of the first upper limit it lies below, `last` beyond them."""
    return df.withColumn("zone", bucket_column(value, zones, last))


def histogram_bins(df: DataFrame, value: str, bins: int = 10, group_by: Sequence[str] = ()) -> DataFrame:
    return distribution_query(df, value, bins, group_by)


def word_counts(df: DataFrame, text: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Frequency of each lower-cased word (runs of letters and digits)."""
    words = F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return (df.select(*group_by, words.alias("word")).filter("word <> ''").groupBy(*group_by, "word")
            .agg(F.count(F.lit(1)).alias("n")))


def paired_t_test(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Paired t statistic of a - b with its degrees of freedom."""
    d = F.expr(a).cast("double") - F.expr(b).cast("double")
    out = df.groupBy(*group_by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_difference"), F.stddev_samp(d).alias("_sd"))
    t = F.try_divide(F.col("mean_difference"), F.col("_sd") / F.sqrt("n"))
    return out.withColumn("t", t).withColumn("df", F.col("n") - 1).drop("_sd")


def waterfall(df: DataFrame, step: str, value: Measure, group_by: Sequence[str] = ()) -> DataFrame:
    """Start and end of each step's bar."""
    per = aggregate(df, [*group_by, step], [value])
    out = running(per, group_by, [step], {"end_value": ("sum", value.name)})
    return out.withColumn("start_value", F.col("end_value") - F.col(value.name))


def time_series_compare(df: DataFrame, time_column: str, grain: str, measure: Measure, shift_months: int,
                        group_by: Sequence[str] = ()) -> DataFrame:
    """A series beside itself some months earlier, with difference and ratio."""
    per = aggregate(df.withColumn("time_period", period(time_column, grain)), [*group_by, "time_period"], [measure])
    out = same_period_join(per, list(group_by), "time_period", [measure.name], shift_months)
    now, before = F.col(measure.name), F.col(f"prior_{measure.name}")
    return out.withColumn("difference", now - before).withColumn("ratio", F.try_divide(now, before))


def time_pivot(df: DataFrame, time_column: str, grain: str, column: str, values: Sequence[Any], agg: str = "sum",
               then: str = "1") -> DataFrame:
    """Periods as rows, listed values as columns."""
    return pivot(df.withColumn("time_period", period(time_column, grain)), ["time_period"], column, values, agg, then=then)


def time_table(df: DataFrame, dimension: str, time_column: str, grain: str, measure: Measure) -> DataFrame:
    """Per dimension value: first and last period, their values and the change."""
    per = aggregate(df.withColumn("time_period", period(time_column, grain)), [dimension, "time_period"], [measure])
    m = measure.name
    out = per.groupBy(dimension).agg(F.min("time_period").alias("first_period"), F.max("time_period").alias("last_period"),
                                     F.min_by(m, "time_period").alias("first_value"), F.max_by(m, "time_period").alias("last_value"),
                                     F.count(F.lit(1)).alias("periods"))
    return out.withColumn("change", F.col("last_value") - F.col("first_value"))


def calendar_heatmap(df: DataFrame, time_column: str, measure: Measure) -> DataFrame:
    """A value for every day between the first and the last, gaps as 0."""
    per = aggregate(df.withColumn("day", F.col(time_column).cast("date")), ["day"], [measure])
    days = spine(span(df, time_column), "day", inclusive=True, name="day")
    return days.join(per, "day", "left").fillna(0, [measure.name])


def grid_bins(df: DataFrame, lat: str, lon: str, size: float, measures: Sequence[Measure]) -> DataFrame:
    """Square cells of `size` degrees, named by their lower corner index."""
    cells = df.withColumns({"cell_y": F.floor(F.col(lat) / size), "cell_x": F.floor(F.col(lon) / size)})
    return aggregate(cells, ["cell_x", "cell_y"], measures)


def hex_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon of `size` holding a point."""
    q = (x * (3 ** 0.5 / 3) - y / 3) / size
    r = (y * 2 / 3) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fixed_q = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fixed_r = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -rq - rs).otherwise(rr)
    return fixed_q.cast("bigint"), fixed_r.cast("bigint")


def hex_bins(df: DataFrame, lat: str, lon: str, size: float, measures: Sequence[Measure]) -> DataFrame:
    q, r = hex_cell(F.col(lon), F.col(lat), size)
    return aggregate(df.withColumns({"hex_q": q, "hex_r": r}), ["hex_q", "hex_r"], measures)


def point_clusters(df: DataFrame, lat: str, lon: str, zoom: int) -> DataFrame:
    """Points merged per map cell of a zoom level: centre and number."""
    size = 360.0 / 2 ** zoom
    return grid_bins(df, lat, lon, size, [Measure("points", "count"), Measure("center_lat", "avg", lat), Measure("center_lon", "avg", lon)])


def parallel_coordinates(df: DataFrame, entity: str, measures: Sequence[Measure]) -> DataFrame:
    """Measures per entity, each scaled to 0..1 over all entities."""
    per = aggregate(df, [entity], measures)
    ends = per.agg(F.struct(*[F.min(m.name).cast("double").alias(f"lo_{m.name}") for m in measures],
                            *[F.max(m.name).cast("double").alias(f"hi_{m.name}") for m in measures])).scalar()
    out = per.withColumn("_e", ends)
    for m in measures:
        lo, hi = F.col(f"_e.lo_{m.name}"), F.col(f"_e.hi_{m.name}")
        out = out.withColumn(f"{m.name}_scaled", F.try_divide(F.col(m.name) - lo, hi - lo))
    return out.drop("_e")


def radar_profile(df: DataFrame, entity: str, measures: Sequence[Measure]) -> DataFrame:
    """Long form of the scaled measures: entity, measure, value, scaled."""
    wide = parallel_coordinates(df, entity, measures)
    axes = F.explode(F.array(*[F.struct(F.lit(m.name).alias("measure"), F.col(m.name).cast("double").alias("value"),
                                        F.col(f"{m.name}_scaled").alias("scaled")) for m in measures]))
    return wide.select(entity, axes.alias("a")).select(entity, "a.*")


def stacked_100_percent(df: DataFrame, x: str, series: str, measure: Measure) -> DataFrame:
    """Share of each series within its x value."""
    per = aggregate(df, [x, series], [measure])
    totals = per.groupBy(x).agg(F.sum(measure.name).alias("_t"))
    return (per.alias("l").join(totals.alias("r"), same("l", "r", [x]), "inner")
            .select("l.*", F.try_divide(F.col(f"l.{measure.name}"), F.col("r._t")).alias("share")))


def trend_line(df: DataFrame, x: str, y: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x with its fit."""
    fx, fy = F.expr(x).cast("double"), F.expr(y).cast("double")
    return df.groupBy(*group_by).agg(F.regr_slope(fy, fx).alias("slope"), F.regr_intercept(fy, fx).alias("intercept"),
                                     F.regr_r2(fy, fx).alias("r2"))


def zones_of(mapping: Mapping[str, float]) -> list[tuple[float, str]]:
    """{label: upper limit} to ordered zones."""
    return sorted(((limit, label) for label, limit in mapping.items()))
