"""Layered models: staging, intermediate, mart, and declarative specs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filter, conjunction
from ..operators.joins import equi_join

NAME_LIMIT = 63


@dataclass(frozen=True)
class ModelColumn:
    """An output column: SQL expression, optional type."""

    name: str
    expression: str | None = None
    type: str | None = None

    def to_column(self) -> Column:
        c = F.expr(self.expression) if self.expression else F.col(self.name)
        return (c.cast(self.type) if self.type else c).alias(self.name)


@dataclass(frozen=True)
class ModelJoin:
    right: str
    on: Mapping[str, str]
    how: str = "left"
    condition: str | None = None


def staging_model(df: DataFrame, primary_key: Sequence[str], columns: Sequence[ModelColumn],
                  tenant: str | None = None, tenant_column: str = "tenant_id", where: str | None = None) -> DataFrame:
    """One-to-one projection of a source: keys first, then tenant, then typed columns."""
    by_name = {c.name: c for c in columns}
    keys = [by_name.pop(k, ModelColumn(k)) for k in primary_key]
    out = df.filter(where) if where else df
    extra = [F.lit(tenant).alias(tenant_column)] if tenant is not None else []
    return out.select(*[k.to_column() for k in keys], *extra, *[c.to_column() for c in by_name.values()])


def generic_model(df: DataFrame, expressions: Sequence[str], where: str | None = None) -> DataFrame:
    return (df.filter(where) if where else df).selectExpr(*expressions)


@dataclass
class ModelSpec:
    """Declarative model: filtered sources, joins, computed columns, grouping.

    `sources` maps a name to a frame or (frame, where). The first one is the
    primary side of every join.
    """

    sources: Mapping[str, DataFrame | tuple[DataFrame, str]]
    joins: Sequence[ModelJoin] = ()
    columns: Sequence[ModelColumn] = ()
    where: Sequence[Filter | str] = ()
    group_by: Sequence[str] = ()
    aggregations: Mapping[str, str] = field(default_factory=dict)
    having: str | None = None
    order_by: Sequence[str] = ()


def build_model(spec: ModelSpec) -> DataFrame:
    """Filter, join, select, group, filter groups, order.

    Output columns are the named `columns` (all columns when none are given);
    with grouping they are `group_by` and the aggregations.
    """
    frames = {}
    for name, source in spec.sources.items():
        df, where = source if isinstance(source, tuple) else (source, None)
        frames[name] = df.filter(where) if where else df
    names = list(frames)
    df = frames[names[0]]
    for j in spec.joins:
        df = equi_join(df, frames[j.right], j.on, j.how, j.condition)
    if spec.where:
        df = df.filter(conjunction(list(spec.where)))
    if spec.aggregations or spec.group_by:
        computed = {c.name: c.to_column() for c in spec.columns}
        df = df.withColumns(computed) if computed else df
        df = df.groupBy(*spec.group_by).agg(*[F.expr(e).alias(n) for n, e in spec.aggregations.items()])
    elif spec.columns:
        df = df.select(*[c.to_column() for c in spec.columns])
    if spec.having:
        df = df.filter(spec.having)
    if spec.order_by:
        df = df.orderBy(*[F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in spec.order_by])
    return df


def snake_case(name: str) -> str:
    """Safe identifier: lower snake case, no leading digit, at most 63 characters."""
    text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    text = re.sub(r"[^0-9A-Za-z]+", "_", text).strip("_").lower()
    text = re.sub(r"_+", "_", text) or "column"
    return (f"_{text}" if text[0].isdigit() else text)[:NAME_LIMIT]


# Fixed value: the characters a slug keeps.
SLUG_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")


def slugify(value: str) -> str:
    """Value as a column name part: words joined by underscores, other characters dropped."""
    words = re.split(r"[ -]+", value.lower())
    slug = "_".join("".join(ch for ch in w if ch in SLUG_CHARACTERS) for w in words)
    return f"_{slug}" if slug[:1].isdigit() else slug


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Normalised unique column names; repeats get a number."""
    names: list[str] = []
    for c in df.columns:
        base = name = snake_case(c)
        n = 1
        while name in names:
            n += 1
            name = f"{base[:NAME_LIMIT - 1 - len(str(n))]}_{n}"
        names.append(name)
    return df.toDF(*names)


def star(df: DataFrame, exclude: Sequence[str] = (), prefix: str = "", suffix: str = "") -> DataFrame:
    hidden = {e.lower() for e in exclude}
    return df.select(*[F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns if c.lower() not in hidden])


def filtered_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    hidden = {e.lower() for e in exclude}
    return [c for c in df.columns if c.lower() not in hidden]


def nullcheck(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Empty strings become NULL in text columns."""
    wanted = set(columns or df.columns)
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if kind == "string" and c in wanted else F.col(c)
                       for c, kind in df.dtypes])
