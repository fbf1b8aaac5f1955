"""Predicates: comparison operators, filter lists, periods and row visibility."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _listed(value: Any) -> list:
    return list(value) if isinstance(value, (list, tuple, set)) else [value]


def _bounds(value: Any) -> tuple[Any, Any]:
    if isinstance(value, Mapping):
        return value["start"], value["end"]
    low, high = value
    return low, high


def _in(c: Column, v: Any) -> Column:
    return c.isin(_listed(v)) if _listed(v) else F.lit(True)


def _not_in(c: Column, v: Any) -> Column:
    return ~c.isin(_listed(v)) if _listed(v) else F.lit(True)


OPERATORS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "in": _in,
    "not in": _not_in,
    "like": lambda c, v: c.like(v),
    "not like": lambda c, v: ~c.like(v),
    "contains": lambda c, v: c.contains(v),
    "ilike": lambda c, v: c.ilike(v),
    "similar to": lambda c, v: c.rlike(f"^(?:{v})$"),
    "between": lambda c, v: c.between(*_bounds(v)),
    "outside": lambda c, v: ~c.between(*_bounds(v)),
    "is null": lambda c, v: c.isNull(),
    "is not null": lambda c, v: c.isNotNull(),
}


@dataclass(frozen=True)
class Filter:
    """One condition; `column` may be any SQL expression."""

    column: str
    operator: str = "="
    value: Any = None

    def to_column(self, resolve: Mapping[str, str] | None = None) -> Column:
        op = self.operator.strip().lower().replace("_", " ")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        return OPERATORS[op](_col((resolve or {}).get(self.column, self.column)), self.value)


def conjunction(filters: Sequence[Filter | Column | str], resolve: Mapping[str, str] | None = None) -> Column:
    """AND of filters; an empty list keeps every row."""
    parts = [f.to_column(resolve) if isinstance(f, Filter) else _col(f) for f in filters]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_rows(df: DataFrame, *filters: Filter | Column | str) -> DataFrame:
    return df.filter(conjunction(filters))


def filters_from_map(spec: Mapping[str, Any]) -> list[Filter]:
    """{dim: value | [values] | {operator, value}} to a list of filters."""
    out = []
    for column, value in spec.items():
        if isinstance(value, Mapping):
            out.append(Filter(column, value["operator"], value.get("value")))
        elif isinstance(value, (list, tuple, set)):
            out.append(Filter(column, "in", list(value)))
        else:
            out.append(Filter(column, "=", value))
    return out


def merge_filters(*scopes: Sequence[Filter]) -> list[Filter]:
    """All scopes (local, query, override) apply together; repeats are dropped."""
    merged: list[Filter] = []
    for f in (f for scope in scopes for f in scope):
        if f not in merged:
            merged.append(f)
    return merged


def time_range(column: str | Column, start: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds; for a timestamp the end is midnight of `end`."""
    c, parts = _col(column), []
    if start is not None:
        parts.append(c >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        parts.append(c <= F.lit(end).cast("timestamp_ntz"))
    return conjunction(parts)


def relative_period(column: str | Column, period: str, as_of: str, n: int | None = None) -> Column:
    """Half-open range of days named relative to `as_of`.

    `period`: today, yesterday, last_week, last_month, last_quarter, last_year,
    last_n_days, mtd, qtd, ytd. Bounds are literals, so they reach the scan.
    """
    day = F.lit(as_of).cast("date")
    month, quarter, year = (F.trunc(day, u) for u in ("month", "quarter", "year"))
    sunday = F.date_sub(day, F.dayofweek(day) - 1)
    tomorrow = F.date_add(day, 1)
    ranges = {
        "today": (day, tomorrow),
        "yesterday": (F.date_sub(day, 1), day),
        "last_week": (F.date_sub(sunday, 7), sunday),
        "last_month": (F.add_months(month, -1), month),
        "last_quarter": (F.add_months(quarter, -3), quarter),
        "last_year": (F.add_months(year, -12), year),
        "mtd": (month, tomorrow),
        "qtd": (quarter, tomorrow),
        "ytd": (year, tomorrow),
    }
    if period == "last_n_days":
        if not n:
            raise ValueError("last_n_days needs n")
        start, end = F.date_sub(day, n - 1), tomorrow
    else:
        start, end = ranges[period]
    c = _col(column)
    return (c >= start.cast("timestamp_ntz")) & (c < end.cast("timestamp_ntz"))


def tenant_rows(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    """Rows of one tenant; apply it to every input before joining."""
    return df.filter(F.col(column) == tenant)


@dataclass
class RowPolicy:
    """Rows a user may see: `column` must hold one of the user's attribute values."""

    column: str
    attribute: str
    bypass_roles: frozenset[str] = field(default_factory=frozenset)


def visible_rows(df: DataFrame, policies: Sequence[RowPolicy], user: Mapping[str, Any]) -> DataFrame:
    """All policies must pass unless one of the user's roles bypasses them."""
    for policy in policies:
        if policy.bypass_roles & set(user.get("roles", ())):
            continue
        allowed = _listed(user.get(policy.attribute, []))
        df = df.filter(F.col(policy.column).isin(allowed) if allowed else F.lit(False))
    return df


def visible_rows_by_grant(df: DataFrame, grants: DataFrame, user: str, on: Mapping[str, str]) -> DataFrame:
    """Row policy held in a grants table (column `user_name`): left semi join."""
    mine = grants.filter(F.col("user_name") == user).select(*[F.col(g).alias(f"_g_{g}") for g in on.values()])
    cond = conjunction([F.col(c) == F.col(f"_g_{g}") for c, g in on.items()])
    return df.join(mine, cond, "left_semi")


def bucket_column(column: str | Column, thresholds: Sequence[tuple[Any, str]], otherwise: str) -> Column:
    """Label of the first threshold the value lies below."""
    c = _col(column)
    out = F
    for limit, label in thresholds:
        out = out.when(c < limit, F.lit(label))
    return out.otherwise(F.lit(otherwise))
