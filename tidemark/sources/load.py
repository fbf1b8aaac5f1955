"""Load strategies as functions of (target, batch), and incremental extraction.

Each returns the new table content; publish it with `VersionedTable.publish`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import HOT_ROWS, first_per_group, framed, same
from ..session import materialize
from .writers import ROWS_PER_FILE, replace_partition, spread_files


def merge_upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], cursor: str | None = None) -> DataFrame:
    """Newest update per key replaces the key's target rows; new keys are added.

    With a cursor, an update older than the key's newest target row is dropped.
    The winning updates, one per key, are stored once and read by both sides of
    the merge.
    """
    if not keys:
        raise ValueError("merge needs key columns")
    tie = [f"-{c}" for c, k in updates.dtypes if c not in keys and c != cursor and not k.startswith("map")]
    newest = first_per_group(updates, keys, ([f"-{cursor}"] if cursor else []) + tie or list(keys))
    if cursor:
        seen = target.groupBy(*keys).agg(F.max(cursor).alias("_seen"))
        newest = (newest.alias("n").join(seen.alias("o"), same("n", "o", keys), "left")
                  .filter(F.col("_seen").isNull() | (F.col(f"n.{cursor}") >= F.col("_seen"))).select("n.*"))
    winners = materialize(newest, "updates")
    kept = target.alias("l").join(winners.select(*keys).alias("r"), same("l", "r", keys), "left_anti")
    return kept.unionByName(winners, allowMissingColumns=True)


def merge_partitions(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], partition: str,
                     cursor: str | None = None, rows_per_file: int = ROWS_PER_FILE, listed: int = 10_000) -> DataFrame:
    """Upsert into a partitioned parquet table, reading and rewriting only the partitions the updates name.

    A key must always fall into the same partition (say, its creation month).
    Up to `listed` partitions reach the scan as literals, more by a join; NULL
    is a partition like any other. The merged partitions are stored aside
    before they replace the old ones; running the same updates again gives the
    same table.
    """
    table = spark.read.parquet(path)
    updates = updates.withColumn(partition, F.col(partition).cast(table.schema[partition].dataType))
    named = updates.select(partition).distinct()
    values = [r[0] for r in named.limit(listed + 1).collect()]
    if len(values) <= listed:
        wanted = F.col(partition).isin([v for v in values if v is not None])
        touched = table.filter(wanted | F.col(partition).isNull() if None in values else wanted)
    else:
        touched = table.alias("t").join(named.alias("u"), same("t", "u", [partition]), "left_semi")
    merged = materialize(merge_upsert(touched, updates, keys, cursor), "merge")
    replace_partition(spread_files(merged, partition, rows_per_file), path, partition)
    return spark.read.parquet(path)


def scd1_merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], cursor: str | None = None) -> DataFrame:
    """Attributes overwritten in place."""
    return merge_upsert(target, batch, keys, cursor)


def delete_insert(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delete target rows whose key is in the batch, then add the whole batch."""
    kept = target.alias("l").join(batch.select(*keys).distinct().alias("r"), same("l", "r", keys), "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


def _changed(tracked: Sequence[str]) -> Column:
    tests = [~F.col(f"o.`{c}`").eqNullSafe(F.col(f"n.`{c}`")) for c in tracked]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def scd2_initial(batch: DataFrame, as_of: str | Column, valid_from: str = "valid_from",
                 valid_to: str = "valid_to") -> DataFrame:
    """First load: every row is a current version."""
    at = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return batch.withColumn(valid_from, at).withColumn(valid_to, F.lit(None).cast("timestamp_ntz"))


def scd2_merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], tracked: Sequence[str] | None = None,
               *, as_of: str | Column, valid_from: str = "valid_from", valid_to: str = "valid_to",
               retire_missing: bool = False, current_flag: str | None = None,
               newest_by: Sequence[str] = (), only_newer: str | None = None) -> DataFrame:
    """Slowly changing dimension with history.

    A changed key closes its open version at `as_of` (a time, or a column of
    the batch) and opens a new one; a new key opens one; an unchanged key is
    left alone, so a replay changes nothing. `retire_missing` closes open keys
    absent from the batch; it needs a fixed time. Of several batch rows with
    one key the first by `newest_by` (`-column` for descending) counts, ties by
    all other columns. With `only_newer` a key changes only where that column
    is larger than in the open version.
    """
    attributes = [c for c in batch.columns if c not in keys]
    ordered = [c.lstrip("-") for c in newest_by]
    rest = [f"-{c}" for c, k in batch.dtypes if c not in keys and c not in ordered and not k.startswith("map")]
    batch = first_per_group(batch, keys, [*newest_by, *rest] or list(keys))
    tracked = list(tracked) if tracked is not None else attributes
    if retire_missing and not isinstance(as_of, str):
        raise ValueError("closing missing keys needs a fixed as_of")
    at = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast(target.schema[valid_from].dataType)
    batch = batch.withColumn("_at", at)
    at = F.lit(as_of).cast(target.schema[valid_from].dataType) if isinstance(as_of, str) else F.col("n._at")
    base = target.drop(current_flag) if current_flag and current_flag in target.columns else target
    columns = base.columns
    history = base.filter(F.col(valid_to).isNotNull())
    current = base.filter(F.col(valid_to).isNull())
    pairs = current.withColumn("_old", F.lit(True)).alias("o").join(
        batch.withColumn("_new", F.lit(True)).alias("n"), same("o", "n", keys), "full")
    old, new = F.col("o._old").isNotNull(), F.col("n._new").isNotNull()
    changed = old & new & _changed(tracked)
    if only_newer:
        changed = changed & F.coalesce(F.col(f"n.`{only_newer}`") > F.col(f"o.`{only_newer}`"), F.col(f"o.`{only_newer}`").isNull())
    closes = changed | (old & ~new & F.lit(retire_missing))
    opens = (new & ~old) | changed
    # one pass over the pairs: each pair yields its old version, its new one, or both
    old_row = F.struct(*[
        F.when(closes, at).otherwise(F.col(f"o.`{valid_to}`")).alias(c) if c == valid_to
        else F.col(f"o.`{c}`").alias(c) for c in columns])
    new_row = F.struct(*[
        at.alias(c) if c == valid_from else F.lit(None).cast(base.schema[c].dataType).alias(c) if c == valid_to
        else F.col(f"n.`{c}`").cast(base.schema[c].dataType).alias(c) if c in batch.columns
        else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in columns])
    versions = pairs.select(F.explode(F.array_compact(F.array(F.when(old, old_row), F.when(opens, new_row)))).alias("v"))
    out = history.unionByName(versions.select("v.*"))
    return out.withColumn(current_flag, F.col(valid_to).isNull()) if current_flag else out


def scd2_apply_changes(target: DataFrame | None, changes: DataFrame, keys: Sequence[str], tracked: Sequence[str],
                       changed_at: str, valid_from: str = "valid_from", valid_to: str = "valid_to",
                       block_rows: int = HOT_ROWS) -> DataFrame:
    """History from a feed of changes that each carry their own time, many per key if need be.

    A change that alters nothing opens no version. A change not later than the
    key's open version is dropped, so a replayed feed adds nothing.
    """
    columns = [*keys, *tracked]
    fresh = first_per_group(changes.select(*columns, F.col(changed_at).alias(valid_from)), [*keys, valid_from], list(tracked))
    history = None
    if target is not None:
        history = target.filter(F.col(valid_to).isNotNull())
        current = target.filter(F.col(valid_to).isNull()).select(*columns, valid_from)
        since = current.select(*keys, F.col(valid_from).alias("_since"))
        later = F.col("_since").isNull() | (F.col(f"n.{valid_from}") > F.col("_since"))
        fresh = fresh.alias("n").join(since.alias("o"), same("n", "o", keys), "left").filter(later).select("n.*")
        fresh = current.unionByName(fresh)
    state = F.struct(*tracked)
    steps = framed(fresh, keys, [valid_from], {"_before": lambda w: F.lag(state).over(w)}, before=1, block_rows=block_rows)
    opened = steps.filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")
    versions = framed(opened, keys, [valid_from], {valid_to: lambda w: F.lead(valid_from).over(w)}, after=1,
                      block_rows=block_rows)
    return versions if history is None else history.select(*versions.columns).unionByName(versions)


def snapshot_table(snapshot: DataFrame | None, source: DataFrame, keys: Sequence[str], strategy: str = "check",
                   updated_at: str | None = None, check_columns: Sequence[str] | None = None,
                   as_of: str | None = None) -> DataFrame:
    """SCD2 of a whole table.

    `timestamp` opens a version where `updated_at` is newer than in the open
    one, valid from that time; `check` compares columns, valid from `as_of`.
    """
    if strategy == "timestamp":
        if not updated_at:
            raise ValueError("the timestamp strategy needs updated_at")
        at = F.col(updated_at).cast("timestamp_ntz")
        if snapshot is None:
            return scd2_initial(source, at)
        return scd2_merge(snapshot, source, keys, [updated_at], as_of=at, only_newer=updated_at, newest_by=[f"-{updated_at}"])
    if as_of is None:
        raise ValueError("the check strategy needs as_of")
    if snapshot is None:
        return scd2_initial(source, as_of)
    return scd2_merge(snapshot, source, keys, check_columns, as_of=as_of)


def incremental_extract(source: DataFrame, cursor: str, last_value=None, initial_value=None) -> DataFrame:
    """Rows past the cursor. The bound is a literal, so it reaches the scan."""
    start = last_value if last_value is not None else initial_value
    return source if start is None else source.filter(F.col(cursor) > F.lit(start))


def next_cursor(extracted: DataFrame, cursor: str, previous=None):
    """Cursor to store once the load has succeeded."""
    top = extracted.agg(F.max(cursor)).first()[0]
    return previous if top is None else top


def incremental_model(target: DataFrame | None, source: DataFrame, updated_at: str, unique_key: Sequence[str] = (),
                      strategy: str = "append") -> DataFrame:
    """New source rows since the target's newest, applied by strategy."""
    if target is None:
        return source
    since = target.agg(F.max(updated_at).alias("_since")).first()[0]
    fresh = incremental_extract(source, updated_at, since)
    if strategy == "append":
        return target.unionByName(fresh, allowMissingColumns=True)
    if strategy == "delete+insert":
        return delete_insert(target, fresh, unique_key)
    if strategy == "merge":
        return merge_upsert(target, fresh, unique_key, updated_at)
    raise ValueError(f"unknown strategy {strategy!r}")

