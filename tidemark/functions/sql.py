"""Time functions of the warehouse's SQL dialect as Spark SQL functions.

They are SQL expressions, so Catalyst inlines them into the query.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Dialect name, argument type, result type, Spark expression over `x`.
DIALECT = [
    ("toDate", "timestamp", "date", "cast(x as date)"),
    ("toStartOfHour", "timestamp", "timestamp", "date_trunc('hour', x)"),
    ("toStartOfDay", "timestamp", "timestamp", "date_trunc('day', x)"),
    ("toStartOfWeek", "timestamp", "date", "date_sub(cast(x as date), dayofweek(x) - 1)"),
    ("toMonday", "timestamp", "date", "date_sub(cast(x as date), weekday(x))"),
    ("toStartOfMonth", "timestamp", "date", "trunc(cast(x as date), 'month')"),
    ("toStartOfQuarter", "timestamp", "date", "trunc(cast(x as date), 'quarter')"),
    ("toStartOfYear", "timestamp", "date", "trunc(cast(x as date), 'year')"),
    ("toDayOfWeek", "timestamp", "int", "weekday(x) + 1"),
    ("toHour", "timestamp", "int", "hour(x)"),
]


def register_dialect(spark: SparkSession) -> None:
    """Make the dialect's time functions available to `spark.sql` in this session."""
    for name, takes, gives, body in DIALECT:
        spark.sql(f"create or replace temporary function {name}(x {takes}) returns {gives} return {body}")
