"""Writing tables: append, replace, partitions, exports."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 2_000_000


def write_append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite the whole table. The frame must not read from `path`."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


class VersionedTable:
    """A table folder whose numbered sub-folders are complete versions.

    The live version is the highest one Spark has marked as finished, so a job
    that dies half way leaves the live version as it was, and a table may be
    rebuilt from its own content. A writer claims its number by creating a file,
    so of two writers that race for a number one fails before it writes.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, suffix: str = "") -> list[int]:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v-*{suffix}")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        return sorted({int(re.search(r"/v-(\d+)", f.getPath().toString()).group(1)) for f in found})

    def exists(self) -> bool:
        return bool(self._numbers("/_SUCCESS"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v-{self._numbers('/_SUCCESS')[-1]:08d}")

    def publish(self, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        number = max([*self._numbers(), *self._numbers(".claim")], default=0) + 1
        claim = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v-{number:08d}.claim")
        files = claim.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.createNewFile(claim):
            raise RuntimeError(f"another writer took version {number} of {self.path}")
        df.write.partitionBy(*partition_by).parquet(f"{self.path}/v-{number:08d}")
        return self.read()

    def clean(self, keep: int = 2) -> int:
        """Delete all but the newest `keep` finished versions, and what died before them; readers of old versions must be done."""
        done = self._numbers("/_SUCCESS")
        oldest = done[-keep] if len(done) >= keep else 0
        gone = [n for n in {*self._numbers(), *self._numbers(".claim")} if n < oldest]
        for number in gone:
            for name in (f"v-{number:08d}", f"v-{number:08d}.claim"):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(gone)


def spread_files(df: DataFrame, partition: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Rows dealt out so that a partition is written by as many tasks as its rows ask for.

    Rows go by a hash of all columns, so a hot key does not make a large task.
    """
    files = df.groupBy(partition).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    dealt = df.alias("l").join(files.alias("r"), F.col(f"l.`{partition}`").eqNullSafe(F.col(f"r.`{partition}`"))).select("l.*", "_files")
    hashed = F.xxhash64(*[c for c, k in df.dtypes if not k.startswith("map")])
    return dealt.repartition(F.col(partition), F.pmod(hashed, F.col("_files"))).drop("_files")


def partitioned_write(df: DataFrame, path: str, date_column: str, sort_keys: Sequence[str],
                      partition: str = "month", rows_per_file: int = ROWS_PER_FILE, mode: str = "overwrite") -> None:
    """Month folders with files of about `rows_per_file` rows, each sorted by the keys."""
    dated = df.withColumn(partition, F.date_format(date_column, "yyyyMM"))
    (spread_files(dated, partition, rows_per_file).sortWithinPartitions(partition, *sort_keys)
     .write.mode(mode).partitionBy(partition).parquet(path))


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions present in the frame."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def drop_partition(spark: SparkSession, path: str, partition: str, value) -> bool:
    """Delete the folder of one partition (None: the NULL partition); no other partition is read or written."""
    name = "__HIVE_DEFAULT_PARTITION__" if value is None else spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{partition}={name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def update_where(df: DataFrame, predicate: str | Column, assignments: dict[str, str | Column]) -> DataFrame:
    """Set columns of matching rows; a NULL predicate leaves the row alone."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    new = {}
    for name, value in assignments.items():
        value = F.expr(value) if isinstance(value, str) else value
        new[name] = F.when(cond, value).otherwise(F.col(name)).cast(df.schema[name].dataType)
    return df.withColumns(new)


def delete_where(df: DataFrame, predicate: str | Column) -> DataFrame:
    """Drop matching rows; a NULL predicate keeps the row."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.filter(~F.coalesce(cond, F.lit(False)))


def expire_rows(df: DataFrame, column: str, days: int = 730, as_of: str | None = None) -> DataFrame:
    """Rows younger than the retention; `as_of` defaults to today."""
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    return df.filter(F.col(column) >= F.date_sub(today, days).cast("timestamp_ntz"))


def evolve_schema(df: DataFrame, add: dict[str, str] | None = None, drop: Sequence[str] = (),
                  modify: dict[str, str] | None = None, rename: dict[str, str] | None = None,
                  clear: Sequence[str] = ()) -> DataFrame:
    """Add (name to type), drop, retype, rename and clear columns, in that order."""
    for name, kind in (add or {}).items():
        df = df.withColumn(name, F.lit(None).cast(kind))
    df = df.drop(*drop)
    for name, kind in (modify or {}).items():
        df = df.withColumn(name, F.col(name).cast(kind))
    df = df.withColumnsRenamed(rename or {})
    for name in clear:
        df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
    return df


def sample_table(df: DataFrame, keys: Sequence[str], keep: int, of: int = 100) -> DataFrame:
    """Deterministic sample: all rows of a key are in or out together.

    A key's place is the start of the md5 of its values as text, joined by a
    bar, so other systems can draw the same sample.
    """
    name = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return df.filter(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("bigint") % of < keep)


def export_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)
