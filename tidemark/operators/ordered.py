"""Ordered computations that never gather a large group in one task.

A plain window sorts a whole partition key inside one task. Each operator here
first counts the rows per group. When no group exceeds `hot_rows`, it is a plain
window: one shuffle, one sort. Otherwise the rows are stored with a row number,
range-partitioned by (keys, order, row number) into chunks of about `hot_rows`
rows and stored with their chunk number. Chunks are windowed in parallel, and a
small summary per chunk carries state from one chunk to the next. The row number
makes the order total, so rows that tie, however many, spread over chunks as
well. Both ways give the same rows where the order is total; among rows that tie
either way picks one of the orders a window may pick.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

HOT_ROWS = 2_000_000
Order = Sequence[str]  # column names, "-name" sorts descending


def sort_columns(order: Order) -> list[Column]:
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys of two aliased frames."""
    parts = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def group_sizes(df: DataFrame, partition: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups; counts are combined before the shuffle."""
    if not partition:
        n = df.count()
        return n, n
    sizes = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("_n"))
    row = sizes.agg(F.coalesce(F.max("_n"), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    return row[0], row[1]


def has_hot_group(df: DataFrame, partition: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Does any group hold more than `hot_rows` rows?"""
    return group_sizes(df, partition)[0] > hot_rows


def in_chunks(df: DataFrame, partition: Sequence[str], order: Order, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows stored with `_chunk`, ascending along (partition, order).

    Range partitioning samples the keys, so chunks are about equal however the
    rows are spread over groups. Rows that tie go by `_row`, a number stored
    with them before they are dealt out, so a retried task deals the same way.
    Storing the chunk fixes it for every later pass.
    """
    n = max(math.ceil(total / hot_rows), 2)
    numbered = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranged = numbered.repartitionByRange(n, *[F.col(p) for p in partition], *sort_columns(order), F.col("_row"))
    return materialize(ranged.withColumn("_chunk", F.spark_partition_id()), "chunks")


def total_order(order: Order) -> list[Column]:
    """The order of chunked rows: ties by their stored number."""
    return [*sort_columns(order), F.col("_row").asc()]


def _chunked_if_hot(df: DataFrame, partition: Sequence[str], order: Order, hot_rows: int) -> DataFrame | None:
    largest, total = group_sizes(df, partition)
    return in_chunks(df, partition, order, total, hot_rows) if largest > hot_rows else None


def _carry(chunked: DataFrame, partition: Sequence[str], totals: dict[str, Column],
           carry: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Summaries of all earlier chunks of a group, for groups that lie in several chunks.

    Chunks are contiguous, so only the first group of a chunk can come from an
    earlier one: there is at most one row per chunk.
    """
    per_chunk = chunked.groupBy(*partition, "_chunk").agg(*[c.alias(n) for n, c in totals.items()])
    w = Window.partitionBy(*partition).orderBy("_chunk")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return (per_chunk.select(*partition, "_chunk", F.row_number().over(w).alias("_nth"),
                             *[fn(before).alias(n) for n, fn in carry.items()])
            .filter(F.col("_nth") > 1).drop("_nth"))


def _with_carry(local: DataFrame, carried: DataFrame, partition: Sequence[str]) -> DataFrame:
    extra = [c for c in carried.columns if c not in (*partition, "_chunk")]
    return (local.alias("l").join(F.broadcast(carried).alias("c"), same("l", "c", [*partition, "_chunk"]), "left")
            .select("l.*", *[F.col(f"c.`{c}`") for c in extra]))


def number_rows(df: DataFrame, partition: Sequence[str], order: Order, name: str = "row_number",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact row_number. The order must be total for a repeatable result."""
    chunked = _chunked_if_hot(df, partition, order, hot_rows)
    if chunked is None:
        whole = Window.partitionBy(*partition).orderBy(*sort_columns(order))
        return df.withColumn(name, F.row_number().over(whole).cast("bigint"))
    return _number_chunks(chunked, partition, order, name)


def _number_chunks(chunked: DataFrame, partition: Sequence[str], order: Order, name: str) -> DataFrame:
    here = Window.partitionBy(*partition, "_chunk").orderBy(*total_order(order))
    local = chunked.withColumn("_ln", F.row_number().over(here))
    carried = _carry(chunked, partition, {"_n": F.count(F.lit(1))},
                     {"_off": lambda w: F.sum("_n").over(w)})
    return (_with_carry(local, carried, partition)
            .withColumn(name, (F.col("_ln") + F.coalesce("_off", F.lit(0))).cast("bigint"))
            .drop("_ln", "_off", "_chunk", "_row"))


def rank_rows(df: DataFrame, partition: Sequence[str], order: Order, rank: str = "rank",
              dense: str = "dense_rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact rank and dense_rank.

    With a hot group, ranks come from the counts of equal order values, so not
    even rows that are all equal meet in one task; rows get their rank back by
    a join on those values, whose hot keys adaptive execution splits.
    """
    if group_sizes(df, partition)[0] <= hot_rows:
        whole = Window.partitionBy(*partition).orderBy(*sort_columns(order))
        return df.withColumns({rank: F.rank().over(whole).cast("bigint"),
                               dense: F.dense_rank().over(whole).cast("bigint")})
    keys = list(dict.fromkeys([*partition, *[o.lstrip("-") for o in order]]))
    counted = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counted")
    placed = number_rows(running(counted, partition, order, {"_cum": ("sum", "_n")}, hot_rows), partition, order, "_d", hot_rows)
    return (df.alias("l").join(materialize(placed, "ranks").alias("r"), same("l", "r", keys))
            .select("l.*", (F.col("_cum") - F.col("_n") + 1).cast("bigint").alias(rank), F.col("_d").alias(dense)))


# how a local running value and the value carried in from earlier chunks combine
_COMBINE = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_REAGG = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, partition: Sequence[str], order: Order, measures: dict[str, tuple[str, str]],
            hot_rows: int = HOT_ROWS, short: bool = False) -> DataFrame:
    """Unbounded-preceding sum / count / min / max: {out: (function, column)}.

    `short` says that the caller knows no group is long, which saves the count.
    """
    chunked = None if short else _chunked_if_hot(df, partition, order, hot_rows)
    if chunked is None:
        whole = (Window.partitionBy(*partition).orderBy(*sort_columns(order))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumns({n: _AGG[fn](c).over(whole) for n, (fn, c) in measures.items()})
    here = (Window.partitionBy(*partition, "_chunk").orderBy(*total_order(order))
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local, totals, carry = chunked, {}, {}
    for i, (name, (fn, col)) in enumerate(measures.items()):
        local = local.withColumn(name, _AGG[fn](col).over(here))
        totals[f"_t{i}"] = _AGG[fn](col)
        carry[f"_c{i}"] = lambda w, i=i, fn=fn: _REAGG[fn](f"_t{i}").over(w)
    out = _with_carry(local, _carry(chunked, partition, totals, carry), partition)
    for i, (name, (fn, _)) in enumerate(measures.items()):
        out = out.withColumn(name, _COMBINE[fn](F.col(name), F.col(f"_c{i}")))
    return out.drop("_chunk", "_row", *[f"_c{i}" for i in range(len(measures))])


def framed(df: DataFrame, partition: Sequence[str], order: Order,
           columns: dict[str, Callable[[WindowSpec], Column]], before: int = 0, after: int = 0,
           block_rows: int = HOT_ROWS) -> DataFrame:
    """Window functions that look at most `before` / `after` rows away.

    With a hot group, rows are numbered exactly, cut into blocks of
    `block_rows`, and each block receives copies of the few neighbouring rows
    its frames can reach.
    """
    block_rows = max(block_rows, before, after, 1)
    chunked = _chunked_if_hot(df, partition, order, block_rows)
    if chunked is None:
        whole = Window.partitionBy(*partition).orderBy(*sort_columns(order))
        return df.withColumns({name: fn(whole) for name, fn in columns.items()})
    rn = _number_chunks(chunked, partition, order, "_rn")
    block = F.floor((F.col("_rn") - 1) / block_rows)
    inside = F.pmod(F.col("_rn") - 1, F.lit(block_rows))
    homes = [F.struct(block.alias("b"), F.lit(False).alias("halo"))]
    guests = []
    if before:
        guests.append(F.when(inside >= block_rows - before,
                             F.struct((block + 1).alias("b"), F.lit(True).alias("halo"))))
    if after:
        guests.append(F.when((inside < after) & (block > 0),
                             F.struct((block - 1).alias("b"), F.lit(True).alias("halo"))))
    spread = rn.withColumn("_home", F.explode(F.array_compact(F.array(*homes, *guests))))
    spread = spread.select("*", F.col("_home.b").alias("_b"), F.col("_home.halo").alias("_halo")).drop("_home")
    spec = Window.partitionBy(*partition, "_b").orderBy("_rn")
    return (spread.withColumns({name: fn(spec) for name, fn in columns.items()})
            .filter(~F.col("_halo")).drop("_rn", "_b", "_halo"))


def count_values(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Distinct non-null values `_v` per group with their number of rows `_n`; numbers keep their type, others become double."""
    number = isinstance(df.select(value).schema[0].dataType, T.NumericType)
    return (df.filter(F.col(value).isNotNull()).groupBy(*groups, (F.col(value) if number else F.col(value).cast("double")).alias("_v"))
            .agg(F.count(F.lit(1)).alias("_n")))


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, wanted: dict[str, float],
                      discrete: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles per group: {out: probability}.

    Values are counted before the sort, and the running count of a hot group is
    chunked, so neither a frequent value nor a large group sits in one task. They
    are told apart and ordered in their own type, so neighbours beyond 2^53 stay
    two. A discrete quantile is one of the values, a continuous one a double.
    """
    short = not has_hot_group(df, groups, hot_rows)  # rows bound distinct values from above
    counted = count_values(df, groups, value)
    return percentiles_of_counts(counted if short else materialize(counted, "counted"), groups, wanted, discrete, short, hot_rows)


def percentiles_of_counts(counted: DataFrame, groups: Sequence[str], wanted: dict[str, float], discrete: bool = False,
                          short: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact quantiles from `count_values`; `counted` should be stored unless every group is short."""
    cum = running(counted, groups, ["_v"], {"_cum": ("sum", "_n")}, hot_rows, short)
    totals = counted.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if groups:
        placed = (cum.alias("l").join(totals.alias("t"), same("l", "t", groups), "inner")
                  .select("l.*", "t._total"))
    else:
        placed = cum.withColumn("_total", totals.scalar())

    def at(index: Column) -> Column:
        return F.max(F.when((index < F.col("_cum")) & (index >= F.col("_cum") - F.col("_n")), F.col("_v")))

    aggs = []
    for name, p in wanted.items():
        if discrete:
            aggs.append(at(F.greatest(F.ceil(F.lit(p) * F.col("_total")) - 1, F.lit(0))).alias(name))
            continue
        spot = F.lit(p) * (F.col("_total") - 1)
        low, high = at(F.floor(spot)).cast("double"), at(F.ceil(spot)).cast("double")
        part = F.max(spot - F.floor(spot))
        aggs.append((low + (high - low) * part).alias(name))
    return placed.groupBy(*groups).agg(*aggs)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Order, n: int = 1) -> DataFrame:
    """The first `n` rows of each key.

    Spark limits each map task to `n` rows per key before the shuffle
    (WindowGroupLimit), so a hot key sends at most `n` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
