"""The shapes every quality test is built from. A test returns its failing rows; none means it passed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import exact_percentiles, same


def col(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def kept(df: DataFrame, row_condition: str | Column | None) -> DataFrame:
    return df if row_condition is None else df.filter(row_condition)


def between(value: Column, low=None, high=None, strictly: bool = False) -> Column:
    """True inside the given bounds; NULL stays NULL."""
    if low is None and high is None:
        raise ValueError("give a lower or an upper bound")
    tests = []
    if low is not None:
        tests.append(value > low if strictly else value >= low)
    if high is not None:
        tests.append(value < high if strictly else value <= high)
    return reduce(lambda a, b: a & b, tests)


def failing(df: DataFrame, truth: Column, row_condition=None) -> DataFrame:
    """Rows where the truth is false; NULL passes."""
    return kept(df, row_condition).filter(~truth)


def failing_groups(df: DataFrame, value: Column, truth, group_by: Sequence[str] = (), row_condition=None) -> DataFrame:
    """Groups whose aggregate `value` fails `truth(column)`."""
    agg = kept(df, row_condition).groupBy(*group_by).agg(value.alias("expression"))
    return agg.filter(~truth(F.col("expression")))


def failing_quantile(df: DataFrame, column: str, probability: float, truth, group_by: Sequence[str] = (),
                     row_condition=None) -> DataFrame:
    """Like `failing_groups` for an exact quantile, which is sorted in parallel."""
    rows = kept(df, row_condition).withColumn("_x", col(column))
    out = exact_percentiles(rows, group_by, "_x", {"expression": probability})
    return out.filter(~truth(F.col("expression")))


def compare_aggregates(a: DataFrame, b: DataFrame, value_a: Column, value_b: Column, group_by: Sequence[str] = (),
                       compare_group_by: Sequence[str] | None = None, tolerance: float = 0.0,
                       tolerance_percent: float | None = None, row_condition=None,
                       compare_row_condition=None) -> DataFrame:
    """Groups whose two aggregates differ by more than the tolerance; a missing side counts as 0."""
    left = kept(a, row_condition).groupBy(*group_by).agg(value_a.alias("expression"))
    theirs = list(compare_group_by or group_by)
    right = (kept(b, compare_row_condition)
             .groupBy(*[F.col(c).alias(g) for c, g in zip(theirs, group_by)]).agg(value_b.alias("compare_expression")))
    if group_by:
        both = (left.alias("l").join(right.alias("r"), same("l", "r", group_by), "full")
                .select(*[F.coalesce(f"l.{g}", f"r.{g}").alias(g) for g in group_by], "expression", "compare_expression"))
    else:
        both = left.withColumn("compare_expression", right.scalar())
    zero = F.lit(0)
    diff = F.abs(F.coalesce("expression", zero) - F.coalesce("compare_expression", zero))
    both = both.withColumn("expression_difference", diff).withColumn(
        "expression_difference_percent", F.try_divide(F.col("expression_difference"), F.col("expression").cast("double")))
    if tolerance_percent is not None:
        return both.filter(F.col("expression_difference_percent") > tolerance_percent)
    return both.filter(F.col("expression_difference") > tolerance)


def not_ignored(columns: Sequence[str], ignore_row_if: str = "all_values_are_missing") -> Column:
    """Rows a multi-column test looks at."""
    nulls = [F.col(c).isNull() for c in columns]
    if ignore_row_if == "all_values_are_missing":
        return ~reduce(lambda a, b: a & b, nulls)
    if ignore_row_if == "any_value_is_missing":
        return ~reduce(lambda a, b: a | b, nulls)
    raise ValueError(f"unknown ignore_row_if {ignore_row_if!r}")


def schema_finding(df: DataFrame, findings: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Schema problems (column, expected, actual) with the number of rows they touch."""
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(e).alias("expected"), F.lit(a).alias("actual"))
            for c, e, a in findings]
    kind = "array<struct<column_name:string,expected:string,actual:string>>"
    listed = F.array(*rows) if rows else F.array().cast(kind)
    return (df.agg(F.count(F.lit(1)).alias("affected_rows")).withColumn("f", F.explode(listed))
            .select("f.column_name", "f.expected", "f.actual", "affected_rows"))
