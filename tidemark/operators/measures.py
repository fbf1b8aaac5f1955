"""Aggregations of the semantic layer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import Filter, conjunction
from .ordered import exact_percentiles, same

_SIMPLE = {
    "sum": F.sum,
    "count": F.count,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
    "stddev": F.stddev_pop,
    "variance": F.var_pop,
    "stddev_samp": F.stddev_samp,
    "var_samp": F.var_samp,
}
ORDER_STATISTICS = ("median", "percentile", "percentile_disc")


@dataclass(frozen=True)
class Measure:
    """`aggregation(expression)` over the rows that pass the measure's filters."""

    name: str
    aggregation: str
    expression: str = "1"
    percentile: int = 50
    filters: tuple[Filter, ...] = field(default=())
    approximate: bool = False
    additive: bool = True

    def input(self) -> Column:
        value = F.expr(self.expression)
        return F.when(conjunction(self.filters), value) if self.filters else value

    @property
    def probability(self) -> float:
        return 0.5 if self.aggregation == "median" else self.percentile / 100

    @property
    def ordered(self) -> bool:
        return self.aggregation in ORDER_STATISTICS and not self.approximate

    def to_column(self) -> Column:
        agg = self.aggregation
        if self.ordered:
            raise ValueError(f"{self.name!r} is an exact order statistic: use `aggregate`, or allow an approximate one")
        if agg in ORDER_STATISTICS:
            return F.percentile_approx(self.input(), self.probability, 10_000).alias(self.name)
        if agg == "count_distinct" and self.approximate:
            agg = "approx_count_distinct"
        if agg not in _SIMPLE:
            raise ValueError(f"unknown aggregation {self.aggregation!r}")
        return _SIMPLE[agg](self.input()).alias(self.name)


def aggregate(df: DataFrame, groups: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Group by existing columns and compute the measures.

    Algebraic measures share one partially aggregated pass. Exact order
    statistics sort the counted values in parallel and join back on the groups.
    """
    plain = [m for m in measures if not m.ordered]
    ordered = [m for m in measures if m.ordered]
    # every group of the input has a row, also one without a value to order
    out = None
    if plain:
        out = df.groupBy(*groups).agg(*[m.to_column() for m in plain])
    elif groups or not ordered:
        out = df.select(*groups).distinct()
    by_input: dict[tuple, list[Measure]] = {}
    for m in ordered:
        by_input.setdefault((m.expression, m.filters, m.aggregation == "percentile_disc"), []).append(m)
    for (_, _, disc), ms in by_input.items():
        part = exact_percentiles(df.withColumn("_x", ms[0].input()), groups, "_x",
                                 {m.name: m.probability for m in ms}, disc)
        if out is None:
            out = part
        elif groups:
            out = (out.alias("l").join(part.alias("r"), same("l", "r", groups), "left")
                   .select("l.*", *[F.col(f"r.`{m.name}`") for m in ms]))
        else:
            for m in ms:
                out = out.withColumn(m.name, part.select(m.name).scalar())
    return out.select(*groups, *[m.name for m in measures])


def count_where(condition: str | Column) -> Column:
    return F.count_if(F.expr(condition) if isinstance(condition, str) else condition)


def sum_where(condition: str | Column, value: str | Column) -> Column:
    cond = F.expr(condition) if isinstance(condition, str) else condition
    return F.sum(F.when(cond, F.expr(value) if isinstance(value, str) else value))
