"""Quality tests. Each function returns the failing rows of one test."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import orphans
from ..operators.ordered import HOT_ROWS, framed, same
from ..operators.reshape import spine
from ..operators.sets import except_both_ways
from ..plans.shapes import period
from .core import (between, col, compare_aggregates, failing, failing_groups, failing_quantile, kept, not_ignored,
                   schema_finding)

_UNITS = {"minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}


def _before(as_of: str, amount: int, part: str) -> Column:
    """`as_of` minus an interval, as a constant the scan can use."""
    if part in _UNITS:
        return (F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {amount * _UNITS[part]} seconds"))
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {amount} {part}")


# ---- values of one column -------------------------------------------------------------------------

def unique(df: DataFrame, column: str, row_condition=None) -> DataFrame:
    rows = kept(df, row_condition).filter(F.col(column).isNotNull())
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


values_unique = unique


def not_null(df: DataFrame, column: str, row_condition=None) -> DataFrame:
    return kept(df, row_condition).filter(col(column).isNull())


values_not_null = not_null


def values_null(df: DataFrame, column: str, row_condition=None) -> DataFrame:
    return kept(df, row_condition).filter(col(column).isNotNull())


def accepted_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return (df.filter(~F.col(column).isin(list(values))).groupBy(F.col(column).alias("value_field"))
            .agg(F.count(F.lit(1)).alias("n_records")))


def not_accepted_values(df: DataFrame, column: str, values: Sequence[Any]) -> DataFrame:
    return df.filter(F.col(column).isin(list(values))).select(F.col(column).alias("value_field")).distinct()


def relationships(child: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    return orphans(child, parent, column, field).select(column)


def relationships_where(child: DataFrame, column: str, parent: DataFrame, field: str, from_condition: str = "true",
                        to_condition: str = "true") -> DataFrame:
    return orphans(child, parent, column, field, from_condition, to_condition).select(column)


def values_between(df: DataFrame, column: str, low=None, high=None, strictly=False, row_condition=None) -> DataFrame:
    return failing(df, between(col(column), low, high, strictly), row_condition)


def accepted_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    return values_between(df, column, low, high, not inclusive)


def expression_is_true(df: DataFrame, expression: str, row_condition=None) -> DataFrame:
    return failing(df, F.expr(expression), row_condition)


def values_in_set(df: DataFrame, column: str, values: Sequence[Any], row_condition=None) -> DataFrame:
    """Rows whose value is not listed; NULL fails."""
    ok = F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return kept(df, row_condition).filter(~ok)


def values_not_in_set(df: DataFrame, column: str, values: Sequence[Any], row_condition=None) -> DataFrame:
    return kept(df, row_condition).filter(F.col(column).isin(list(values)))


def not_empty_string(df: DataFrame, column: str, trim: bool = True) -> DataFrame:
    return df.filter((F.trim(column) if trim else F.col(column)) == "")


def not_null_proportion(df: DataFrame, column: str, at_least: float = 0.0, at_most: float = 1.0,
                        group_by: Sequence[str] = ()) -> DataFrame:
    share = F.avg(F.when(F.col(column).isNull(), 0.0).otherwise(1.0)).alias("not_null_proportion")
    return (df.groupBy(*group_by).agg(share)
            .filter((F.col("not_null_proportion") < at_least) | (F.col("not_null_proportion") > at_most)))


def at_least_one(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups without any non-null value (the whole table when ungrouped)."""
    return df.groupBy(*group_by).agg(F.count(column).alias("non_null")).filter("non_null = 0")


def not_constant(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups with exactly one distinct value; min = max needs no distinct shuffle."""
    ends = df.groupBy(*group_by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return ends.filter(F.col("_lo") == F.col("_hi")).select(*group_by, F.lit(1).cast("bigint").alias("distinct_values"))


def consistent_casing(df: DataFrame, column: str) -> DataFrame:
    """Values that differ only by case."""
    values = df.select(F.col(column).alias("_v")).distinct()
    return (values.groupBy(F.lower("_v").alias("inconsistent_value")).agg(F.count("_v").alias("spellings"))
            .filter("spellings > 1"))


def length_between(df: DataFrame, column: str, low=None, high=None, strictly=False, row_condition=None) -> DataFrame:
    return failing(df, between(F.length(column), low, high, strictly), row_condition)


def length_equal(df: DataFrame, column: str, length: int, row_condition=None) -> DataFrame:
    return failing(df, F.length(column) == length, row_condition)


def _patterns(tests: Sequence[Column], match_on: str) -> Column:
    if match_on not in ("any", "all"):
        raise ValueError("match_on is any or all")
    return reduce(lambda a, b: (a | b) if match_on == "any" else (a & b), tests)


def match_like(df: DataFrame, column: str, pattern: str, row_condition=None) -> DataFrame:
    return failing(df, F.col(column).like(pattern), row_condition)


def not_match_like(df: DataFrame, column: str, pattern: str, row_condition=None) -> DataFrame:
    return failing(df, ~F.col(column).like(pattern), row_condition)


def match_like_list(df: DataFrame, column: str, patterns: Sequence[str], match_on: str = "any", row_condition=None):
    return failing(df, _patterns([F.col(column).like(p) for p in patterns], match_on), row_condition)


def not_match_like_list(df: DataFrame, column: str, patterns: Sequence[str], match_on: str = "any", row_condition=None):
    return failing(df, _patterns([~F.col(column).like(p) for p in patterns], match_on), row_condition)


def _regex(column: str, pattern: str, flags: str) -> Column:
    return F.col(column).rlike(f"(?{flags}){pattern}" if flags else pattern)


def match_regex(df: DataFrame, column: str, regex: str, flags: str = "", row_condition=None) -> DataFrame:
    return failing(df, _regex(column, regex, flags), row_condition)


def not_match_regex(df: DataFrame, column: str, regex: str, flags: str = "", row_condition=None) -> DataFrame:
    return failing(df, ~_regex(column, regex, flags), row_condition)


def match_regex_list(df: DataFrame, column: str, regexes: Sequence[str], match_on: str = "any", flags: str = "",
                     row_condition=None) -> DataFrame:
    return failing(df, _patterns([_regex(column, r, flags) for r in regexes], match_on), row_condition)


def not_match_regex_list(df: DataFrame, column: str, regexes: Sequence[str], match_on: str = "any", flags: str = "",
                         row_condition=None) -> DataFrame:
    return failing(df, _patterns([~_regex(column, r, flags) for r in regexes], match_on), row_condition)


# ---- aggregates of one column ---------------------------------------------------------------------

def _agg_between(fn):
    def test(df: DataFrame, column: str, low=None, high=None, group_by: Sequence[str] = (), strictly: bool = False,
             row_condition=None) -> DataFrame:
        return failing_groups(df, fn(col(column)), lambda v: between(v, low, high, strictly), group_by, row_condition)

    return test


max_between = _agg_between(F.max)
min_between = _agg_between(F.min)
mean_between = _agg_between(F.avg)
sum_between = _agg_between(F.sum)
stdev_between = _agg_between(F.stddev_samp)
unique_count_between = _agg_between(F.count_distinct)
proportion_unique_between = _agg_between(lambda c: F.try_divide(F.count_distinct(c).cast("double"), F.count(c)))


def quantile_between(df: DataFrame, column: str, quantile: float, low=None, high=None, group_by: Sequence[str] = (),
                     strictly: bool = False, row_condition=None) -> DataFrame:
    return failing_quantile(df, column, quantile, lambda v: between(v, low, high, strictly), group_by, row_condition)


def median_between(df: DataFrame, column: str, low=None, high=None, group_by: Sequence[str] = (),
                   strictly: bool = False, row_condition=None) -> DataFrame:
    return quantile_between(df, column, 0.5, low, high, group_by, strictly, row_condition)


def distinct_count_equal(df: DataFrame, column: str, value: int, group_by: Sequence[str] = (), row_condition=None):
    return failing_groups(df, F.count_distinct(col(column)), lambda v: v == value, group_by, row_condition)


def distinct_count_greater_than(df: DataFrame, column: str, value: int, group_by: Sequence[str] = (), row_condition=None):
    return failing_groups(df, F.count_distinct(col(column)), lambda v: v > value, group_by, row_condition)


def distinct_count_less_than(df: DataFrame, column: str, value: int, group_by: Sequence[str] = (), row_condition=None):
    return failing_groups(df, F.count_distinct(col(column)), lambda v: v < value, group_by, row_condition)


def distinct_count_equal_other_table(df: DataFrame, column: str, other: DataFrame, other_column: str,
                                     row_condition=None, compare_row_condition=None) -> DataFrame:
    return compare_aggregates(df, other, F.count_distinct(col(column)), F.count_distinct(col(other_column)),
                              row_condition=row_condition, compare_row_condition=compare_row_condition)


def _distinct_with_set(df: DataFrame, column: str, values: Sequence[Any], row_condition) -> DataFrame:
    """Distinct values and set members, flagged by where they occur."""
    kind = df.select(col(column).alias("v")).schema["v"].dataType
    seen = kept(df, row_condition).select(col(column).alias("value_field")).distinct().withColumn("in_column", F.lit(True))
    wanted = (df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"value_field {kind.simpleString()}")
              .withColumn("in_set", F.lit(True)))
    return (seen.join(wanted, "value_field", "full")
            .select("value_field", F.coalesce("in_column", F.lit(False)).alias("in_column"),
                    F.coalesce("in_set", F.lit(False)).alias("in_set")))


def distinct_values_in_set(df: DataFrame, column: str, values: Sequence[Any], row_condition=None) -> DataFrame:
    """Distinct values outside the set; NULL fails."""
    return _distinct_with_set(df, column, values, row_condition).filter("in_column and not in_set").select("value_field")


def distinct_values_contain_set(df: DataFrame, column: str, values: Sequence[Any], row_condition=None) -> DataFrame:
    return _distinct_with_set(df, column, values, row_condition).filter("in_set and not in_column").select("value_field")


def distinct_values_equal_set(df: DataFrame, column: str, values: Sequence[Any], row_condition=None) -> DataFrame:
    return _distinct_with_set(df, column, values, row_condition).filter("in_set <> in_column")


def most_common_value_in_set(df: DataFrame, column: str, values: Sequence[Any], top_n: int = 1, row_condition=None):
    """The value ranked `top_n` by frequency (smaller value first on ties) when it is not listed."""
    counts = kept(df, row_condition).groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("value_count"))
    top = counts.orderBy(F.desc("value_count"), F.asc("value_field")).limit(top_n)  # at most top_n rows from here
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value_count"), F.asc("value_field"))))
    return ranked.filter((F.col("rank") == top_n) & ~F.col("value_field").isin(list(values))).drop("rank")


# ---- order, ranges, sequences ---------------------------------------------------------------------

def _against_previous(df: DataFrame, column: str, sort: str, group_by: Sequence[str], row_condition, block_rows) -> DataFrame:
    rows = kept(df, row_condition).select(*group_by, F.col(sort).alias("sort_column"), F.col(column).alias("value_field"))
    return framed(rows, group_by, ["sort_column", "value_field"],
                  {"value_field_lag": lambda w: F.lag("value_field").over(w)}, before=1, block_rows=block_rows)


def values_increasing(df: DataFrame, column: str, sort_column: str | None = None, strictly: bool = True,
                      group_by: Sequence[str] = (), row_condition=None, block_rows: int = HOT_ROWS) -> DataFrame:
    rows = _against_previous(df, column, sort_column or column, group_by, row_condition, block_rows)
    now, before = F.col("value_field"), F.col("value_field_lag")
    return rows.filter(before.isNotNull() & ~((now > before) if strictly else (now >= before)))


def values_decreasing(df: DataFrame, column: str, sort_column: str | None = None, strictly: bool = True,
                      group_by: Sequence[str] = (), row_condition=None, block_rows: int = HOT_ROWS) -> DataFrame:
    rows = _against_previous(df, column, sort_column or column, group_by, row_condition, block_rows)
    now, before = F.col("value_field"), F.col("value_field_lag")
    return rows.filter(before.isNotNull() & ~((now < before) if strictly else (now <= before)))


def sequential_values(df: DataFrame, column: str, interval: int = 1, datepart: str | None = None,
                      group_by: Sequence[str] = (), block_rows: int = HOT_ROWS) -> DataFrame:
    """Values that are not their predecessor plus the step.

    Equal values are counted before they are put in order, so a value that
    repeats is one row of the walk however often it occurs. It follows its
    predecessor once and itself as often as it repeats, and is listed as often.
    """
    previous = f"previous_{column}"
    counted = df.groupBy(*group_by, column).agg(F.count(F.lit(1)).alias("_n"))
    walk = framed(counted, group_by, [column], {"_before": lambda w: F.lag(column).over(w)}, before=1, block_rows=block_rows)
    now = F.col(column)
    step = lambda c: c + F.expr(f"interval {interval} {datepart}") if datepart else c + interval
    first = F.struct(F.col("_before").alias("_p"), F.lit(1).cast("bigint").alias("_times"))
    again = F.struct(now.alias("_p"), (F.col("_n") - 1).alias("_times"))
    pairs = walk.select(*group_by, column, F.explode(F.array(first, again)).alias("_x")).select(
        *group_by, column, F.col("_x._p").alias(previous), F.col("_x._times").alias("_times"))
    failing_pairs = pairs.filter(F.col(previous).isNotNull() & (F.col("_times") > 0) & ~(now == step(F.col(previous))))
    # as many rows as repeats, listed by a thousand so that no array grows with them
    thousands = failing_pairs.withColumn("_k", F.explode(F.expr("sequence(0L, (_times - 1) div 1000)")))
    return thousands.withColumn("_i", F.explode(F.expr("sequence(1L, least(1000L, _times - _k * 1000))"))).drop("_times", "_k", "_i")


def mutually_exclusive_ranges(df: DataFrame, lower: str, upper: str, partition_by: Sequence[str] = (),
                              gaps: str = "allowed", zero_length_range_allowed: bool = False,
                              block_rows: int = HOT_ROWS) -> DataFrame:
    """Ranges that are inverted, overlap the next one, or break the gap rule."""
    rows = df.select(*partition_by, F.col(lower).alias("lower_bound"), F.col(upper).alias("upper_bound"))
    ahead = framed(rows, partition_by, ["lower_bound", "upper_bound"], {
        "next_lower_bound": lambda w: F.lead("lower_bound").over(w),
        "is_last_record": lambda w: F.lead(F.lit(1)).over(w).isNull()}, after=1, block_rows=block_rows)
    lo, hi, nxt = F.col("lower_bound"), F.col("upper_bound"), F.col("next_lower_bound")
    proper = F.coalesce((lo <= hi) if zero_length_range_allowed else (lo < hi), F.lit(False))
    rule = {"not_allowed": hi == nxt, "allowed": hi <= nxt, "required": hi < nxt}[gaps]
    apart = F.coalesce(rule, F.col("is_last_record"), F.lit(False))
    return ahead.filter(~(proper & apart))


# ---- several columns ------------------------------------------------------------------------------

def pair_a_greater_than_b(df: DataFrame, a: str, b: str, or_equal: bool = False, row_condition=None) -> DataFrame:
    return failing(df, (col(a) >= col(b)) if or_equal else (col(a) > col(b)), row_condition)


def pair_equal(df: DataFrame, a: str, b: str, row_condition=None) -> DataFrame:
    return failing(df, col(a) == col(b), row_condition)


def pair_in_set(df: DataFrame, a: str, b: str, pairs: Sequence[tuple[Any, Any]], row_condition=None) -> DataFrame:
    ok = reduce(lambda x, y: x | y, [(F.col(a) == p) & (F.col(b) == q) for p, q in pairs])
    return failing(df, ok, row_condition)


def unique_combination_of_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_records")).filter("n_records > 1")


def compound_columns_unique(df: DataFrame, columns: Sequence[str], ignore_row_if: str = "all_values_are_missing",
                            row_condition=None) -> DataFrame:
    return unique_combination_of_columns(kept(df, row_condition).filter(not_ignored(columns, ignore_row_if)), columns)


def multicolumn_sum_equal(df: DataFrame, columns: Sequence[str], total: float, group_by: Sequence[str] = (),
                          row_condition=None) -> DataFrame:
    value = reduce(lambda a, b: a + b, [F.sum(c) for c in columns])
    return failing_groups(df, value, lambda v: v == total, group_by, row_condition)


def unique_within_record(df: DataFrame, columns: Sequence[str], ignore_row_if: str = "all_values_are_missing",
                         row_condition=None) -> DataFrame:
    """Rows in which fewer distinct non-null values than columns occur; no shuffle."""
    rows = kept(df, row_condition).filter(not_ignored(columns, ignore_row_if))
    texts = F.array_compact(F.array(*[F.col(c).cast("string") for c in columns]))
    return rows.withColumn("distinct_values", F.size(F.array_distinct(texts))).filter(F.col("distinct_values") < len(columns))


# ---- tables against tables ------------------------------------------------------------------------

def equality(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or a.columns)
    return except_both_ways(a.select(*cols), b.select(*cols))


def cardinality_equality(a: DataFrame, column: str, b: DataFrame, to_column: str) -> DataFrame:
    """Values whose number of rows differs between two tables."""
    left = a.groupBy(F.col(column).alias("value_field")).agg(F.count(F.lit(1)).alias("rows_a"))
    right = b.groupBy(F.col(to_column).alias("value_field")).agg(F.count(F.lit(1)).alias("rows_b"))
    return (left.alias("l").join(right.alias("r"), same("l", "r", ["value_field"]), "full")
            .select(F.coalesce("l.value_field", "r.value_field").alias("value_field"), "rows_a", "rows_b")
            .filter(~F.col("rows_a").eqNullSafe(F.col("rows_b"))))


def _counts(a: DataFrame, b: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Row counts of two tables per group; a missing group counts 0."""
    left = a.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_a"))
    right = b.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_b"))
    if group_by:
        both = (left.alias("l").join(right.alias("r"), same("l", "r", group_by), "full")
                .select(*[F.coalesce(f"l.{g}", f"r.{g}").alias(g) for g in group_by], "_a", "_b"))
    else:
        both = left.withColumn("_b", right.scalar())
    return both.select(*group_by, F.coalesce("_a", F.lit(0)).alias("count_a"), F.coalesce("_b", F.lit(0)).alias("count_b"))


def equal_rowcount(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    return _counts(a, b, group_by).withColumn("diff_count", F.abs(F.col("count_a") - F.col("count_b"))).filter("diff_count <> 0")


def fewer_rows_than(a: DataFrame, b: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """Groups of `a` without fewer rows than `b`; equal counts fail with a delta of 1."""
    delta = F.when(F.col("count_a") == F.col("count_b"), 1).otherwise(F.col("count_a") - F.col("count_b"))
    return _counts(a, b, group_by).withColumn("row_count_delta", delta.cast("bigint")).filter("row_count_delta > 0")


def aggregation_equal_other_table(a: DataFrame, b: DataFrame, expression: str, compare_expression: str | None = None,
                                  group_by: Sequence[str] = (), compare_group_by: Sequence[str] | None = None,
                                  tolerance: float = 0.0, tolerance_percent: float | None = None,
                                  row_condition=None, compare_row_condition=None) -> DataFrame:
    return compare_aggregates(a, b, F.expr(expression), F.expr(compare_expression or expression), group_by,
                              compare_group_by, tolerance, tolerance_percent, row_condition, compare_row_condition)


def row_count_equal_other(a: DataFrame, b: DataFrame, factor: float = 1, group_by: Sequence[str] = (),
                          row_condition=None, compare_row_condition=None) -> DataFrame:
    """Rows of `a` must equal rows of `b` times the factor."""
    return compare_aggregates(a, b, F.count(F.lit(1)), F.count(F.lit(1)) * factor, group_by, None, 0.0, None,
                              row_condition, compare_row_condition)


def row_count_between(df: DataFrame, low=None, high=None, group_by: Sequence[str] = (), strictly: bool = False,
                      row_condition=None) -> DataFrame:
    return failing_groups(df, F.count(F.lit(1)), lambda v: between(v, low, high, strictly), group_by, row_condition)


def row_count_equal(df: DataFrame, value: int, group_by: Sequence[str] = (), row_condition=None) -> DataFrame:
    return failing_groups(df, F.count(F.lit(1)), lambda v: v == value, group_by, row_condition)


# ---- time -----------------------------------------------------------------------------------------

def recency(df: DataFrame, field: str, datepart: str, interval: int, as_of: str, group_by: Sequence[str] = ()) -> DataFrame:
    newest = df.groupBy(*group_by).agg(F.max(col(field).cast("timestamp_ntz")).alias("most_recent"))
    return newest.filter(F.col("most_recent") < _before(as_of, interval, datepart))


def recent_data(df: DataFrame, column: str, datepart: str, interval: int, as_of: str, row_condition=None) -> DataFrame:
    """One row when the newest value is older than the interval; an empty table counts as 1970."""
    newest = kept(df, row_condition).agg(F.max(col(column).cast("timestamp_ntz")).alias("_m"))
    value = F.coalesce("_m", F.lit("1970-01-01").cast("timestamp_ntz")).alias("max_timestamp")
    return newest.select(value).filter(F.col("max_timestamp") < _before(as_of, interval, datepart))


def grouped_recent_data(df: DataFrame, group_by: Sequence[str], column: str, datepart: str, interval: int, as_of: str,
                        row_condition=None) -> DataFrame:
    """Groups whose newest value is too old; values after `as_of` are left out."""
    at = col(column).cast("timestamp_ntz")
    rows = kept(df, row_condition).filter(at <= F.lit(as_of).cast("timestamp_ntz"))
    newest = rows.groupBy(*group_by).agg(F.max(at).alias("latest_timestamp"))
    return newest.filter(F.col("latest_timestamp") < _before(as_of, interval, datepart))


def data_for_every_n_datepart(df: DataFrame, column: str, part: str = "day", interval: int = 1, row_condition=None,
                              exclusion_condition: str | None = None, start: str | None = None,
                              end: str | None = None) -> DataFrame:
    """Periods of the spine without rows; the period of the last date is not tested."""
    rows = kept(df, row_condition)
    day = F.col(column).cast("date")
    bounds = rows.agg(F.coalesce(F.lit(start).cast("date"), F.min(day)).alias("start"),
                      F.coalesce(F.lit(end).cast("date"), F.max(day)).alias("end"))
    kind = "timestamp_ntz" if part == "hour" else "date"
    expected = spine(bounds, part, name="period").withColumn("period", F.col("period").cast(kind))
    present = rows.groupBy(F.date_trunc(part, F.col(column)).cast(kind).alias("period")).agg(F.count(F.lit(1)).alias("_n"))
    if interval > 1:  # `interval` periods from the first one make one tested period
        first = bounds.select("start").scalar()
        steps = lambda c: F.expr({"hour": "timestampdiff(hour, cast(_s as timestamp), cast(period as timestamp))",
                                  "day": "datediff(period, _s)", "week": "floor(datediff(period, _s) / 7)",
                                  "month": "timestampdiff(month, cast(trunc(_s, 'month') as timestamp), cast(period as timestamp))"}[part])
        expected = expected.withColumn("_s", first).filter(F.pmod(steps("period").cast("int"), F.lit(interval)) == 0).drop("_s")
        back = F.pmod(steps("period").cast("int"), F.lit(interval))
        present = present.withColumn("_s", first).withColumn("_b", back)
        moved = {"hour": F.expr("period - make_interval(0, 0, 0, 0, _b)"), "day": F.expr("date_sub(period, _b)"),
                 "week": F.expr("date_sub(period, _b * 7)"), "month": F.expr("add_months(period, -_b)")}[part]
        present = present.withColumn("period", moved.cast(kind)).groupBy("period").agg(F.sum("_n").alias("_n"))
    missing = expected.join(present, "period", "left_anti")
    return missing.filter(exclusion_condition) if exclusion_condition else missing


def within_n_stdevs(df: DataFrame, column: str, group_by: Sequence[str], sigma: float = 3) -> DataFrame:
    """Groups whose total lies more than `sigma` sample deviations from the mean of all totals."""
    totals = df.groupBy(*group_by).agg(F.sum(col(column)).alias("total"))
    stats = totals.agg(F.struct(F.avg("total").alias("mean"), F.stddev_samp("total").alias("sd"))).scalar()
    scored = (totals.withColumn("_s", stats)
              .withColumn("sigma", (F.col("total") - F.col("_s.mean")) / F.nullif(F.col("_s.sd"), F.lit(0.0))).drop("_s"))
    return scored.filter(F.abs("sigma") > sigma)


def within_n_moving_stdevs(df: DataFrame, column: str, date_column: str, as_of: str, grain: str = "day",
                           lookback_periods: int = 1, trend_periods: int = 7, test_periods: int = 14,
                           sigma: float = 3, sigma_upper: float | None = None, sigma_lower: float | None = None,
                           take_diffs: bool = True, take_logs: bool = True, group_by: Sequence[str] = ()) -> DataFrame:
    """Recent periods whose (log) change is unusual against the periods before.

    After the first aggregation there is one row per group and period, so the
    windows below stay short however large the table is.
    """
    upper = sigma if sigma_upper is None else sigma_upper
    lower = -sigma if sigma_lower is None else sigma_lower
    metric = (df.groupBy(period(date_column, grain).alias("metric_period"), *group_by)
              .agg(F.sum(col(column)).alias("metric_value")))
    w = Window.partitionBy(*group_by).orderBy("metric_period")
    # with logs, a period without a value or of value 0, and the time before the first one, count as 0
    scale = lambda c: F.coalesce(F.ln(F.nullif(c, F.lit(0.0))), F.lit(0.0)) if take_logs else c
    test = scale(F.col("metric_value"))
    if take_diffs:
        test = test - scale(F.lag("metric_value", lookback_periods).over(w))
    trend = w.rowsBetween(-trend_periods, -1)
    scored = (metric.withColumn("metric_test_value", test)
              .withColumn("rolling_average", F.avg("metric_test_value").over(trend))
              .withColumn("rolling_stddev", F.stddev_samp("metric_test_value").over(trend)))
    scored = scored.withColumn("metric_sigma", (F.col("metric_test_value") - F.col("rolling_average"))
                               / F.nullif(F.col("rolling_stddev"), F.lit(0.0)))
    stop = period(F.lit(as_of).cast("timestamp_ntz"), grain)
    begin = period(F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {test_periods} {grain}"), grain)
    return scored.filter((F.col("metric_period") >= begin) & (F.col("metric_period") < stop)
                         & ~F.col("metric_sigma").between(lower, upper))


# ---- schema ---------------------------------------------------------------------------------------

def column_type_in_list(df: DataFrame, column: str, types: Sequence[str]) -> DataFrame:
    actual = dict(df.dtypes).get(column, "missing")
    return schema_finding(df, [] if actual in [t.lower() for t in types] else [(column, "|".join(types), actual)])


def column_of_type(df: DataFrame, column: str, kind: str) -> DataFrame:
    return column_type_in_list(df, column, [kind])


def column_exists(df: DataFrame, column: str, index: int | None = None) -> DataFrame:
    """Column present, and at position `index` (from 0) when given; names ignore case."""
    names = [c.lower() for c in df.columns]
    at = names.index(column.lower()) if column.lower() in names else None
    ok = at is not None and (index is None or at == index)
    return schema_finding(df, [] if ok else [(column, f"position {index}" if index is not None else "present", str(at))])


def column_count_between(df: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    n = len(df.columns)
    ok = (low is None or n >= low) and (high is None or n <= high)
    return schema_finding(df, [] if ok else [("*", f"{low}..{high} columns", str(n))])


def column_count_equal(df: DataFrame, value: int) -> DataFrame:
    return column_count_between(df, value, value)


def column_count_equal_other(df: DataFrame, other: DataFrame) -> DataFrame:
    return column_count_equal(df, len(other.columns))


def columns_contain_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = {c.lower() for c in df.columns}
    return schema_finding(df, [(c, "present", "missing") for c in columns if c.lower() not in names])


def columns_not_contain_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = {c.lower() for c in df.columns}
    return schema_finding(df, [(c, "missing", "present") for c in columns if c.lower() in names])


def columns_match_set(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names, wanted = {c.lower() for c in df.columns}, {c.lower() for c in columns}
    return schema_finding(df, [(c, "present", "missing") for c in sorted(wanted - names)]
                          + [(c, "missing", "present") for c in sorted(names - wanted)])


def columns_match_ordered_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    actual = [c.lower() for c in df.columns]
    wanted = [c.lower() for c in columns]
    width = max(len(actual), len(wanted))
    pairs = zip(wanted + ["none"] * (width - len(wanted)), actual + ["none"] * (width - len(actual)))
    return schema_finding(df, [(w if w != "none" else a, f"{i}:{w}", f"{i}:{a}") for i, (w, a) in enumerate(pairs) if w != a])


def schema_contract(df: DataFrame, contract: Mapping[str, tuple[str, bool]]) -> DataFrame:
    """Declared (type, nullable) per column against the frame: missing, wrong type, or NULLs found.

    One scan counts the NULLs of every required column.
    """
    actual = dict(df.dtypes)
    parts = []
    for name, (kind, nullable) in contract.items():
        if name not in actual:
            parts.append((name, kind, F.lit("missing"), F.count(F.lit(1))))
            continue
        if actual[name] != kind:
            parts.append((name, kind, F.lit(actual[name]), F.count(F.lit(1))))
        if not nullable:
            parts.append((name, "not null", F.lit("null"), F.count_if(F.col(name).isNull())))
    listed = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(e).alias("expected"), a.alias("actual"),
                                c.alias("affected_rows")) for n, e, a, c in parts])
    return df.agg(listed.alias("_l")).select(F.explode("_l").alias("f")).select("f.*").filter("affected_rows > 0")


def singular_test(df: DataFrame, sql: str, **others: DataFrame) -> DataFrame:
    """Any SELECT that returns bad rows; `{this}` is the tested frame."""
    return df.sparkSession.sql(sql, this=df, **others)


def referential_sample_check(child: DataFrame, column: str, parent: DataFrame, field: str, sample: int = 1000) -> DataFrame:
    """Foreign keys of a fixed-size pseudo-random sample of distinct keys; one row, warning only."""
    keys = child.filter(F.col(column).isNotNull()).select(F.col(column).alias("_k")).distinct()
    picked = keys.orderBy(F.xxhash64("_k"), "_k").limit(sample)
    found = parent.select(F.col(field).alias("_p")).distinct()
    hit = picked.join(found, F.col("_k") == F.col("_p"), "left")
    return (hit.agg(F.count("_k").alias("checked"), F.count_if(F.col("_p").isNull()).alias("orphan_count"))
            .withColumn("status", F.when(F.col("orphan_count") > 0, "warn").otherwise("pass")))
