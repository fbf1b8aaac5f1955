"""Catalog listing, type mapping, freshness and run audit."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)
TEXT = T.StringType()
# Source type names by the Spark type that holds them.
_NAMES = [
    (T.ByteType(), ["tinyint"]),
    (T.ShortType(), ["smallint", "int2", "smallserial"]),
    (T.IntegerType(), ["integer", "int", "int4", "serial", "mediumint", "year", "interval year to month"]),
    (T.LongType(), ["bigint", "int8", "bigserial", "oid", "interval", "interval day to second"]),
    (T.FloatType(), ["real", "float4", "binary_float"]),
    (T.DoubleType(), ["float", "float8", "double", "double precision", "binary_double", "numeric", "number"]),
    (MONEY, ["decimal", "money", "smallmoney"]),
    (T.BooleanType(), ["boolean", "bool", "bit", "tinyint(1)"]),
    (T.DateType(), ["date"]),
    (T.TimestampType(), ["timestamp", "timestamptz", "timestamp without time zone", "timestamp with time zone",
                         "timestamp with local time zone", "datetime", "datetime2", "smalldatetime",
                         "datetimeoffset"]),
    (T.BinaryType(), ["binary", "varbinary", "bytea", "blob", "tinyblob", "mediumblob", "longblob", "raw", "long raw",
                      "image"]),
    (T.ArrayType(TEXT), ["array", "set"]),
]
TYPE_MAP = {name: kind for kind, names in _NAMES for name in names}
# Names one dialect reads differently.
DIALECT_MAP = {"oracle": {"date": T.TimestampType()}, "mysql": {"float": T.FloatType()},
               "sqlserver": {"tinyint": T.ShortType()}}
ALIASES = {"postgres": "postgresql", "mariadb": "mysql", "mssql": "sqlserver"}


def map_type(source: str | None, dialect: str = "postgresql", allow_lossy: bool = False) -> T.DataType:
    """Spark type of a source type name: whole name first, then the name without its arguments, else text."""
    if not source:
        return TEXT
    text = re.sub(r"\s+", " ", source.strip().lower())
    names = {**TYPE_MAP, **DIALECT_MAP.get(ALIASES.get(dialect, dialect), {})}
    if text in names:
        return names[text]
    args = re.search(r"\(([^)]*)\)", text)
    base = re.sub(r"\s*\([^)]*\)", "", text)
    kind = names.get(base, TEXT)
    if args and base in ("numeric", "decimal", "number"):
        digits = [int(x) for x in args.group(1).split(",")]
        precision, scale = digits[0], digits[1] if len(digits) > 1 else 0
        if precision > 38 and not allow_lossy:
            raise ValueError(f"{source!r} has more than the 38 digits a Spark decimal holds")
        return T.DecimalType(min(precision, 38), min(scale, 38))
    return kind


def map_source_schema(columns: Sequence[tuple[str, str, bool]], dialect: str = "postgresql") -> T.StructType:
    """(name, source type, nullable) triples to a Spark schema."""
    return T.StructType([T.StructField(n, map_type(k, dialect), null) for n, k, null in columns])


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def table_row_count(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of several frames in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def list_relations(spark: SparkSession, database: str | None = None, pattern: str = "*", prefix: str = "",
                   exclude: str = "") -> list[str]:
    """Names of catalog tables and views by glob pattern or prefix."""
    names = sorted(t.name for t in spark.catalog.listTables(database))
    return [n for n in names if fnmatch.fnmatch(n, pattern) and n.startswith(prefix)
            and not (exclude and fnmatch.fnmatch(n, exclude))]


def describe_columns(df: DataFrame, table: str) -> list[tuple[str, str, str, int, bool]]:
    """(table, column, type, position, nullable)."""
    return [(table, f.name, f.dataType.simpleString(), i, f.nullable) for i, f in enumerate(df.schema.fields, 1)]


_SECONDS = {"minute": 60, "hour": 3600, "day": 86400}


def source_freshness(df: DataFrame, loaded_at: str, as_of: str, warn_after: tuple[int, str] = (24, "hour"),
                     error_after: tuple[int, str] = (48, "hour"), name: str = "source") -> DataFrame:
    """One row: newest load, age in seconds, and pass / warn / error."""
    limit = lambda spec: spec[0] * _SECONDS[spec[1]]
    newest = df.agg(F.max(F.col(loaded_at).cast("timestamp")).alias("max_loaded_at"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("max_loaded_at")
    status = (F.when(F.col("age_seconds").isNull() | (F.col("age_seconds") > limit(error_after)), "error")
              .when(F.col("age_seconds") > limit(warn_after), "warn").otherwise("pass"))
    return (newest.withColumn("source_name", F.lit(name)).withColumn("age_seconds", age)
            .withColumn("status", status).select("source_name", "max_loaded_at", "age_seconds", "status"))


def audited_write(df: DataFrame, path: str, job: str, started_at: str, finished_at: str | None = None,
                  mode: str = "append", valid: str | Column | None = None) -> DataFrame:
    """Write the valid rows of a frame and return the run's audit row; a failure is recorded, not raised.

    Rows read and rows written are counted apart while writing; `valid` says
    which rows are written (all, where it is left out).
    """
    import time

    from pyspark.errors import PySparkException
    from pyspark.sql import Observation

    read, kept, begun = Observation("read"), Observation("written"), time.time()
    rows = df.observe(read, F.count(F.lit(1)).alias("rows"))
    rows = rows if valid is None else rows.filter(valid)
    counts, status, error = (None, None), "success", None
    try:
        rows.observe(kept, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
        counts = (read.get["rows"], kept.get["rows"])
    except PySparkException as failure:
        status, error = "failed", str(failure)[:1000]
    return df.sparkSession.createDataFrame(
        [(job, started_at, finished_at, *counts, float(round(time.time() - begun, 3)), status, error)],
        "job_name string, started_at string, finished_at string, rows_read bigint, rows_written bigint, "
        "duration_seconds double, status string, error string")


def tenant_summary(events: DataFrame, audit: DataFrame, time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Event totals beside the rows ingested so far."""
    stats = events.agg(F.count(F.lit(1)).alias("total_events"), F.count_distinct(kind).alias("event_types"),
                       F.min(time).alias("first_event"), F.max(time).alias("last_event"))
    loaded = audit.filter("status = 'success'").agg(F.coalesce(F.sum("rows_written"), F.lit(0))).scalar()
    return stats.withColumn("rows_ingested", loaded.cast("bigint"))
