"""Unions and differences of relations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_relations(relations: Mapping[str, DataFrame], include: Sequence[str] | None = None,
                    exclude: Sequence[str] = (), column_override: Mapping[str, str] | None = None,
                    source_column: str | None = "source_relation", where: str | None = None) -> DataFrame:
    """Union of frames with differing columns: missing ones are NULL, origin is tagged.

    A column whose type differs between frames becomes text unless overridden.
    """
    if include and exclude:
        raise ValueError("give include or exclude, not both")
    override = dict(column_override or {})
    lowered = {x.lower() for x in (include or exclude)}
    kinds: dict[str, set[str]] = {}
    for df in relations.values():
        for name, kind in df.dtypes:
            wanted = name.lower() in lowered if include else name.lower() not in lowered
            if wanted:
                kinds.setdefault(name, set()).add(kind)
    target = {n: override.get(n) or (next(iter(k)) if len(k) == 1 else "string") for n, k in kinds.items()}
    parts = []
    for name, df in relations.items():
        cols = [F.col(c).cast(target[c]).alias(c) for c in df.columns if c in target]
        if source_column:
            cols.insert(0, F.lit(name).alias(source_column))
        parts.append(df.select(*cols))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.filter(where) if where else out


def except_both_ways(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b",
                     column: str = "which_diff") -> DataFrame:
    """Distinct rows found in only one of two frames, labelled.

    One aggregation over the tagged union replaces two set differences.
    """
    cols = a.columns
    tagged = (a.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
              .unionByName(b.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b"))))
    sides = tagged.groupBy(*cols).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return (sides.filter(F.col("_a") != F.col("_b"))
            .withColumn(column, F.when(F.col("_a") == 1, F.lit(f"{name_a}_minus_{name_b}"))
                        .otherwise(F.lit(f"{name_b}_minus_{name_a}"))).drop("_a", "_b"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))
