"""Ranking, navigation, running and share calculations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import HOT_ROWS, Order, first_per_group, framed, number_rows, rank_rows, running, same


def _with_group_count(df: DataFrame, partition: Sequence[str], name: str) -> DataFrame:
    counts = df.groupBy(*partition).agg(F.count(F.lit(1)).alias(name))
    if not partition:
        return df.withColumn(name, counts.scalar())
    return (df.alias("l").join(counts.alias("r"), same("l", "r", partition), "left").select("l.*", f"r.{name}"))


def rankings(df: DataFrame, partition: Sequence[str], order: Order, hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number, rank and dense_rank columns."""
    return rank_rows(number_rows(df, partition, order, "row_number", hot_rows), partition, order,
                     hot_rows=hot_rows)


def ntile(df: DataFrame, partition: Sequence[str], order: Order, n: int, name: str = "ntile",
          hot_rows: int = HOT_ROWS) -> DataFrame:
    """n nearly equal buckets; the first buckets take the remainder."""
    out = _with_group_count(number_rows(df, partition, order, "_rn", hot_rows), partition, "_c")
    size, extra = F.floor(F.col("_c") / n), F.col("_c") % n
    cut = extra * (size + 1)
    small = F.floor((F.col("_rn") - 1) / (size + 1)) + 1
    large = extra + F.floor((F.col("_rn") - cut - 1) / F.greatest(size, F.lit(1))) + 1
    return out.withColumn(name, F.when(F.col("_rn") <= cut, small).otherwise(large).cast("int")).drop("_rn", "_c")


def lag_lead(df: DataFrame, partition: Sequence[str], order: Order, column: str, offset: int = 1,
             block_rows: int = HOT_ROWS) -> DataFrame:
    """lag_<column> and lead_<column>."""
    return framed(df, partition, order, {
        f"lag_{column}": lambda w: F.lag(column, offset).over(w),
        f"lead_{column}": lambda w: F.lead(column, offset).over(w)}, offset, offset, block_rows)


def first_last(df: DataFrame, partition: Sequence[str], order: Order, column: str) -> DataFrame:
    """first_<column> and last_<column> of the whole group on every row.

    Two order-aware aggregates per group joined back: no group is sorted.
    """
    key = F.struct(*[o.lstrip("-") for o in order])
    if any(o.startswith("-") for o in order) and not all(o.startswith("-") for o in order):
        raise ValueError("mixed sort directions are not supported")
    low, high = F.min_by(column, key).alias("a"), F.max_by(column, key).alias("b")
    ends = df.groupBy(*partition).agg(low, high)
    first, last = ("b", "a") if order[0].startswith("-") else ("a", "b")
    return (df.alias("l").join(ends.alias("r"), same("l", "r", partition), "left")
            .select("l.*", F.col(f"r.{first}").alias(f"first_{column}"), F.col(f"r.{last}").alias(f"last_{column}")))


def running_total(df: DataFrame, partition: Sequence[str], order: Order, column: str, name: str = "running_total",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    return running(df, partition, order, {name: ("sum", column)}, hot_rows)


def running_count(df: DataFrame, partition: Sequence[str], order: Order, column: str, name: str = "running_count",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    return running(df, partition, order, {name: ("count", column)}, hot_rows)


def moving_average(df: DataFrame, partition: Sequence[str], order: Order, column: str, rows: int,
                   name: str = "moving_average", block_rows: int = HOT_ROWS) -> DataFrame:
    """Mean of this row and the `rows - 1` before it."""
    return framed(df, partition, order, {name: lambda w: F.avg(column).over(w.rowsBetween(-(rows - 1), 0))},
                  before=rows - 1, block_rows=block_rows)


def percent_of_total(df: DataFrame, column: str, within: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Share of the column's total, over everything or inside a group."""
    totals = df.groupBy(*within).agg(F.sum(column).alias("_t"))
    if within:
        out = (df.alias("l").join(totals.alias("r"), same("l", "r", within), "left").select("l.*", "r._t"))
    else:
        out = df.withColumn("_t", totals.scalar())
    return out.withColumn(name, F.try_divide(F.col(column), F.col("_t"))).drop("_t")


def period_growth(df: DataFrame, partition: Sequence[str], period: str, column: str, periods: int = 1) -> DataFrame:
    """Previous value and growth against it; `df` holds one row per group and period."""
    prev = F.lag(column, periods).over(Window.partitionBy(*partition).orderBy(period))
    out = df.withColumn(f"previous_{column}", prev)
    before = F.col(f"previous_{column}")
    return out.withColumn("growth", F.try_divide(F.col(column) - before, before))


def year_over_year(daily: DataFrame, keys: Sequence[str], day: str, column: str, aligned: bool = True) -> DataFrame:
    """Each day beside the same weekday 364 days earlier, or the same date last year."""
    prior_day = F.date_sub(day, 364) if aligned else F.add_months(day, -12)
    now = daily.select(*keys, day, column).withColumn("_prior", prior_day)
    before = daily.select(*keys, F.col(day).alias("_prior"), F.col(column).alias(f"prior_{column}"))
    return (now.alias("l").join(before.alias("r"), same("l", "r", [*keys, "_prior"]), "left")
            .select(*[f"l.{c}" for c in (*keys, day, column)], f"r.prior_{column}"))


def top_percent(df: DataFrame, order: Order, percent: float) -> DataFrame:
    """The first `percent` of the rows by order, rounded up to whole rows."""
    out = _with_group_count(number_rows(df, [], order, "_rn"), [], "_c")
    return out.filter(F.col("_rn") <= F.ceil(F.col("_c") * percent / 100)).drop("_rn", "_c")


def rank_by_measure(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """Competition rank by a measure, highest first."""
    return rank_rows(df, [], [f"-{column}"], rank=name, dense="_d").drop("_d")


def deduplicate(df: DataFrame, partition_by: Sequence[str], order_by: Order) -> DataFrame:
    """First row per key; NULL keys and NULL values are kept like any other."""
    return first_per_group(df, partition_by, order_by)


def latest_version(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Greatest version per key; remaining columns break ties."""
    rest = [f"-{c}" for c, kind in df.dtypes if c not in (*keys, version) and not kind.startswith("map")]
    return first_per_group(df, keys, [f"-{version}", *rest])
