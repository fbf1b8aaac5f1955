"""Semantic layer: models, dimensions, measures, relationships and queries over them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import Filter, conjunction, filters_from_map, time_range
from ..operators.measures import Measure, aggregate
from ..operators.ordered import same
from ..session import materialize


@dataclass(frozen=True)
class Dimension:
    """A grouping expression; hierarchical ones name their parent level."""

    name: str
    expression: str
    kind: str = "categorical"
    hierarchy: str | None = None
    level: int = 0
    parent: str | None = None


@dataclass
class SemanticModel:
    """A table with dimensions and measures. Column names must be unique in a layer."""

    name: str
    source: DataFrame | Callable[[], DataFrame]
    dimensions: Sequence[Dimension] = ()
    measures: Sequence[Measure] = ()
    kind: str = "fact"
    tenant_column: str | None = None

    def frame(self, tenant: str | None = None) -> DataFrame:
        df = self.source if isinstance(self.source, DataFrame) else self.source()
        if tenant is not None and self.tenant_column:
            df = df.filter(F.col(self.tenant_column) == tenant)
        return df


@dataclass(frozen=True)
class Relationship:
    """An edge of the join graph; extra `condition` is a SQL predicate.

    `cardinality` reads from left to right: many_to_one, one_to_one,
    one_to_many or many_to_many.
    """

    left: str
    right: str
    left_key: str
    right_key: str
    join_type: str = "left"
    condition: str | None = None
    cardinality: str = "many_to_one"

    @property
    def to_many(self) -> bool:
        return self.cardinality.endswith("to_many")

    def flipped(self) -> "Relationship":
        swap = {"left": "right", "right": "left"}
        return Relationship(self.right, self.left, self.right_key, self.left_key,
                            swap.get(self.join_type, self.join_type), self.condition,
                            "_to_".join(reversed(self.cardinality.split("_to_"))))


@dataclass
class SemanticLayer:
    models: Sequence[SemanticModel]
    relationships: Sequence[Relationship] = ()
    _by_name: dict[str, SemanticModel] = field(init=False)

    def __post_init__(self):
        self._by_name = {m.name: m for m in self.models}

    def model(self, name: str) -> SemanticModel:
        return self._by_name[name]

    def find_dimension(self, name: str) -> tuple[SemanticModel, Dimension]:
        for m in self.models:
            for d in m.dimensions:
                if d.name == name:
                    return m, d
        raise KeyError(f"unknown dimension {name!r}")

    def find_measure(self, name: str) -> tuple[SemanticModel, Measure]:
        for m in self.models:
            for x in m.measures:
                if x.name == name:
                    return m, x
        raise KeyError(f"unknown measure {name!r}")

    def join_path(self, start: str, goal: str) -> list[Relationship]:
        """Shortest chain of relationships, walked in either direction."""
        queue = deque([(start, [])])
        seen = {start}
        while queue:
            here, path = queue.popleft()
            if here == goal:
                return path
            for rel in self.relationships:
                for edge in (rel, rel.flipped()):
                    if edge.left == here and edge.right not in seen:
                        seen.add(edge.right)
                        queue.append((edge.right, [*path, edge]))
        raise ValueError(f"no relationship path from {start!r} to {goal!r}")

    def joined(self, primary: str, needed: Sequence[str], tenant: str | None = None,
               base: DataFrame | None = None) -> DataFrame:
        """The primary model (or `base` in its place) joined with every needed model along its path."""
        df, present = self.model(primary).frame(tenant) if base is None else base, {primary}
        for goal in needed:
            for edge in self.join_path(primary, goal):
                if edge.right in present:
                    continue
                right = self.model(edge.right).frame(tenant)
                on = df[edge.left_key] == right[edge.right_key]
                if edge.condition:
                    on = on & F.expr(edge.condition)
                df = df.join(right, on, edge.join_type)
                present.add(edge.right)
        return df


@dataclass
class SemanticQuery:
    measures: Sequence[str]
    dimensions: Sequence[str] = ()
    filters: Sequence[Filter] | Mapping[str, Any] = ()
    having: Sequence[Filter] = ()
    time_dimension: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    order_by: Sequence[str] = ()
    limit: int | None = None
    offset: int = 0
    tenant: str | None = None
    pre_aggregate: bool = False


_REDUCE = ("sum", "count", "min", "max")


def semantic_frame(layer: SemanticLayer, q: SemanticQuery) -> tuple[DataFrame, list[Measure]]:
    """The filtered join of a query with its dimensions as columns, and the measures to compute over it.

    With `pre_aggregate` the fact is first reduced to one row per join key and
    own dimension. That pays when the dimensions are too big to broadcast: the
    join then shuffles groups instead of rows, and when the join key is the only
    group the fact is already partitioned for that join.
    """
    measures = [layer.find_measure(n) for n in q.measures]
    filters = filters_from_map(q.filters) if isinstance(q.filters, Mapping) else list(q.filters)
    used = list(dict.fromkeys([*q.dimensions, *[f.column for f in filters],
                               *([q.time_dimension] if q.time_dimension else [])]))
    dims = {n: layer.find_dimension(n) for n in used}
    if measures:
        primary = next((m.name for m, _ in measures if m.kind == "fact"), measures[0][0].name)
    else:
        primary = dims[q.dimensions[0]][0].name
    needed = list(dict.fromkeys([m.name for m, _ in measures] + [m.name for m, _ in dims.values()]))
    others = [n for n in needed if n != primary]
    resolve = {n: d.expression for n, (_, d) in dims.items()}
    asked = [x for _, x in measures]
    conditions = [(f.column, f.to_column(resolve)) for f in filters]
    if q.time_dimension and (q.date_from or q.date_to):
        conditions.append((q.time_dimension, time_range(resolve[q.time_dimension], q.date_from, q.date_to)))
    base = None
    if q.pre_aggregate and others:
        own = [n for n, (m, _) in dims.items() if m.name == primary]
        keys = list(dict.fromkeys(e.left_key for g in others for e in layer.join_path(primary, g) if e.left == primary))
        kept = list(dict.fromkeys([*keys, *[n for n in own if n in q.dimensions]]))
        distinct = lambda x: x.aggregation == "count_distinct" and x.expression in keys and not x.filters
        unconditional = not any(e.condition for g in others for e in layer.join_path(primary, g))
        if unconditional and all(x.aggregation in _REDUCE or distinct(x) for x in asked):
            rows = layer.model(primary).frame(q.tenant).filter(conjunction([c for n, c in conditions if n in own]))
            rows = rows.withColumns({n: F.expr(resolve[n]) for n in own if n in q.dimensions})
            base = rows.groupBy(*kept).agg(*[x.to_column() for x in asked if not distinct(x)] or [F.count(F.lit(1)).alias("_n")])
            conditions = [(n, c) for n, c in conditions if n not in own]
            resolve |= {n: f"`{n}`" for n in own}
            # totals of totals: counts add up like sums
            asked = [x if distinct(x) else Measure(x.name, "sum" if x.aggregation == "count" else x.aggregation, f"`{x.name}`")
                     for x in asked]
    near, far = _split_at_to_many(layer, primary, others) if any(x.aggregation not in _REPEATABLE for x in asked) else (others, {})
    beyond = {n for n, (m, _) in dims.items() if any(m.name in goals for goals in far.values())}
    df = layer.joined(primary, near, q.tenant, base).filter(conjunction([c for n, c in conditions if n not in beyond]))
    df = df.withColumns({n: F.expr(resolve[n]) for n in q.dimensions if n not in beyond})
    for edge, goals in far.items():
        own = [n for n in beyond if dims[n][0].name in goals]
        side = layer.joined(edge.right, [g for g in goals if g != edge.right], q.tenant)
        wanted = [c for n, c in conditions if n in own]
        shown = [n for n in q.dimensions if n in own]
        if edge.condition:
            df = _join_groups_on_condition(df, side.filter(conjunction(wanted)), edge, {n: F.expr(resolve[n]) for n in shown}, bool(wanted))
            continue
        # one row per join key and group: a measured row counts once in each of its groups
        side = side.filter(conjunction(wanted)).select(F.col(edge.right_key).alias("_key"), *[F.expr(resolve[n]).alias(n) for n in shown]).distinct()
        df = df.join(side, df[edge.left_key] == side["_key"], "inner" if wanted else edge.join_type).drop("_key")
    return df, asked


def _join_groups_on_condition(df: DataFrame, side: DataFrame, edge: Relationship, shown: Mapping[str, Any], filtered: bool) -> DataFrame:
    """Measured rows once in each group that some far row satisfying the edge's condition puts them in.

    Whether a far row counts depends on the measured row, so the far side can't
    be reduced by its key alone. Measured rows are numbered and stored; their
    distinct pairs of number and group, found over the join, meet them again
    before anything is measured.
    """
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "measured")
    far = side.withColumns({f"_shown_{n}": e for n, e in shown.items()}) if shown else side
    met = numbered.join(far, (numbered[edge.left_key] == far[edge.right_key]) & F.expr(edge.condition), "inner")
    pairs = met.select("_row", *[F.col(f"_shown_{n}").alias(n) for n in shown]).distinct()
    kept = "inner" if filtered or edge.join_type == "inner" else "left"
    return numbered.join(pairs, "_row", kept).drop("_row")


# aggregations that repeated rows don't change
_REPEATABLE = ("min", "max", "count_distinct", "approx_count_distinct")


def _split_at_to_many(layer: SemanticLayer, primary: str, goals: Sequence[str]) -> tuple[list[str], dict[Relationship, list[str]]]:
    """Models to join as they are, and by first to-many edge those beyond it, whose rows would repeat measured rows."""
    near, far = [], {}
    for goal in goals:
        path = layer.join_path(primary, goal)
        edge = next((e for e in path if e.to_many), None)
        if edge is None:
            near.append(goal)
            continue
        near += [e.right for e in path[:path.index(edge)]]
        far.setdefault(edge, []).append(goal)
    return list(dict.fromkeys(near)), far


def semantic_query(layer: SemanticLayer, q: SemanticQuery) -> DataFrame:
    """Slice and dice: join, filter, group, aggregate, order, page.

    Measures of several fact models are aggregated apart at the shared
    dimensions and then joined, so that no fact multiplies another.
    """
    dims = list(q.dimensions)
    facts: dict[str, list[str]] = {}
    for name in q.measures:
        facts.setdefault(layer.find_measure(name)[0].name, []).append(name)
    parts = []
    for names in [n for n in facts.values()] or [[]]:
        df, measures = semantic_frame(layer, replace(q, measures=names))
        parts.append((aggregate(df, dims, measures), names))
    out, _ = parts[0]
    for part, names in parts[1:]:
        if dims:
            kept = [c for c in out.columns if c not in dims]
            out = (out.alias("l").join(part.alias("r"), same("l", "r", dims), "full")
                   .select(*[F.coalesce(f"l.{d}", f"r.{d}").alias(d) for d in dims],
                           *[F.col(f"l.{c}") for c in kept], *[F.col(f"r.{n}") for n in names]))
        else:
            for n in names:
                out = out.withColumn(n, part.select(n).scalar())
    out = out.select(*dims, *q.measures)
    if q.having:
        out = out.filter(conjunction(q.having))
    return page(out, q.order_by, q.limit, q.offset)


def page(df: DataFrame, order_by: Sequence[str] = (), limit: int | None = None, offset: int = 0,
         max_limit: int | None = None) -> DataFrame:
    """Validated ordering ("-name" descends) with limit and offset; a limit over `max_limit` is refused."""
    if limit is not None and (limit < 0 or max_limit is not None and limit > max_limit):
        raise ValueError(f"limit {limit} is not between 0 and {max_limit}")
    unknown = [o for o in order_by if o.lstrip("-") not in df.columns]
    if unknown:
        raise ValueError(f"cannot order by {unknown}")
    if order_by:
        df = df.orderBy(*[F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order_by])
    if offset:
        df = df.offset(offset)
    return df.limit(limit) if limit is not None else df
