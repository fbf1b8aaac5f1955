"""Pivot, unpivot, series and spines."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.models import slugify

_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
            "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "avg": F.avg}


def pivot(df: DataFrame, group_by: Sequence[str], column: str, values: Sequence[Any], agg: str = "sum", cmp: str = "=",
          prefix: str = "", suffix: str = "", then: str | Column = "1", otherwise: str | Column | None = "0",
          distinct: bool = False, slug: bool = False) -> DataFrame:
    """One conditional aggregate per listed value, in a single pass."""
    as_col = lambda x: F.expr(x) if isinstance(x, str) else x
    cells = []
    for value in values:
        cell = F.when(_COMPARE[cmp](F.col(column), F.lit(value)), as_col(then))
        if otherwise is not None:
            cell = cell.otherwise(as_col(otherwise))
        label = slugify(str(value)) if slug else str(value)
        if distinct:
            out = F.count_distinct(cell) if agg == "count" else F.sum_distinct(cell)
        else:
            out = _AGG[agg](cell)
        cells.append(out.alias(f"{prefix}{label}{suffix}"))
    return df.groupBy(*group_by).agg(*cells)


def pivot_values(df: DataFrame, column: str, max_values: int = 1000) -> list:
    """Distinct values of a column for `pivot`; refuses a column with too many."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{column} has more than {max_values} values; name the ones to pivot")
    return sorted(r[0] for r in rows)


def unpivot(df: DataFrame, exclude: Sequence[str], remove: Sequence[str] = (), cast_to: str = "string",
            field_name: str = "field_name", value_name: str = "value") -> DataFrame:
    """Columns to (name, value) rows; NULL values stay."""
    hidden = {c.lower() for c in (*exclude, *remove)}
    melted = [c for c in df.columns if c.lower() not in hidden]
    cast = df.select(*exclude, *[F.col(c).cast(cast_to).alias(c) for c in melted])
    return cast.unpivot(list(exclude), melted, field_name, value_name)


def generate_series(spark: SparkSession, n: int, name: str = "generated_number") -> DataFrame:
    """1..n, generated in parallel."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def span(df: DataFrame, column: str) -> DataFrame:
    """One row: the first and last date of a column (`start`, `end`)."""
    day = F.col(column).cast("date")
    return df.agg(F.min(day).alias("start"), F.max(day).alias("end"))


def spine(bounds: DataFrame, part: str = "day", start: str = "start", end: str = "end", inclusive: bool = False,
          name: str | None = None) -> DataFrame:
    """One row per period from `start` up to but not including `end`.

    `bounds` is a one-row frame, so the range may come straight from data.
    """
    name = name or f"date_{part}"
    hourly = part == "hour"
    first = F.col(start).cast("timestamp" if hourly else "date")
    last = F.col(end).cast("timestamp" if hourly else "date")
    steps = F.explode(F.when(first <= last, F.sequence(first, last, F.expr(f"interval 1 {part}"))))
    out = bounds.select(F.col(end).alias("_end"), steps.alias(name))
    if hourly:
        out = out.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return (out if inclusive else out.filter(F.col(name) < F.col("_end"))).drop("_end")


def date_spine(spark: SparkSession, part: str, start: str, end: str, inclusive: bool = False,
               name: str | None = None) -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("start"),
                                   F.lit(end).cast("timestamp_ntz").alias("end"))
    return spine(bounds, part, inclusive=inclusive, name=name)
