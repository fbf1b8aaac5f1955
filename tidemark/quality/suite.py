"""Running many quality tests over a table and recording the results."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import checks
from .core import between

# Tests implied by a column's name.
NAME_TESTS = [
    (r"^id$", ["unique", "not_null"]),
    (r"_id$", ["not_null"]),
    (r"^email$", ["not_null"]),
    (r"^status$", ["not_null"]),
    (r"^type$", ["not_null"]),
    (r"^created_at$", ["not_null"]),
    (r"^updated_at$", ["not_null"]),
    (r"^tenant_id$", ["not_null"]),
]


@dataclass(frozen=True)
class Check:
    """One test. Exactly one of three forms:

    `failing`: row predicate that is true for a bad row;
    `value` with bounds: an aggregate that must lie in [low, high];
    `frame`: function of the table returning bad rows.
    """

    name: str
    column: str = ""
    kind: str = ""
    failing: Column | None = None
    value: Column | None = None
    low: float | None = None
    high: float | None = None
    frame: Callable[[DataFrame], DataFrame] | None = None
    severity: str = "ERROR"


def not_null(column: str, **kw) -> Check:
    return Check(f"not_null_{column}", column, "not_null", failing=F.col(column).isNull(), **kw)


def unique(column: str, **kw) -> Check:
    return Check(f"unique_{column}", column, "unique", frame=lambda df: checks.unique(df, column), **kw)


def accepted_values(column: str, values: Sequence, **kw) -> Check:
    return Check(f"accepted_values_{column}", column, "accepted_values", failing=~F.col(column).isin(list(values)), **kw)


def in_range(column: str, low=None, high=None, **kw) -> Check:
    return Check(f"in_range_{column}", column, "accepted_range", failing=~between(F.col(column), low, high), **kw)


def matches(column: str, regex: str, **kw) -> Check:
    return Check(f"matches_{column}", column, "match_regex", failing=~F.col(column).rlike(regex), **kw)


def expression(name: str, truth: str, **kw) -> Check:
    return Check(name, "", "expression", failing=~F.expr(truth), **kw)


def aggregate_between(name: str, column: str, value: Column, low=None, high=None, **kw) -> Check:
    return Check(name, column, "aggregate", value=value, low=low, high=high, **kw)


def relationship(column: str, parent: DataFrame, field: str, **kw) -> Check:
    return Check(f"relationship_{column}", column, "relationships",
                 frame=lambda df: checks.relationships(df, column, parent, field), **kw)


def infer_default_tests(df: DataFrame, primary_key: Sequence[str] = (), required: Sequence[str] = ()) -> list[Check]:
    """Tests implied by keys, required columns and column names."""
    found: dict[tuple[str, str], Check] = {}
    make = {"unique": unique, "not_null": not_null}
    for c in df.columns:
        wanted = ["unique", "not_null"] if c in primary_key else ["not_null"] if c in required else []
        for pattern, tests in NAME_TESTS:
            if re.search(pattern, c):
                wanted = wanted + tests
        for test in wanted:
            found.setdefault((test, c), make[test](c))
    return list(found.values())


def run_quality_suite(df: DataFrame, table: str, tests: Sequence[Check], checked_at: str | None = None,
                      run_id: str = "") -> DataFrame:
    """One result row per test.

    All row predicates and aggregates share a single scan of the table; only
    tests that need their own grouping or join add jobs. `sample_failures`
    holds one failing value (the smallest), so nothing unbounded is gathered.
    """
    rows = [c for c in tests if c.failing is not None]
    aggs = [c for c in tests if c.value is not None]
    frames = [c for c in tests if c.frame is not None]
    null = F.lit(None).cast("string")
    parts = []
    if rows or aggs:
        measured = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(rows):
            bad = F.coalesce(c.failing, F.lit(False))
            measured.append(F.count_if(bad).alias(f"f{i}"))
            if c.column:
                measured.append(F.min(F.when(bad, F.col(c.column).cast("string"))).alias(f"s{i}"))
        measured += [c.value.cast("double").alias(f"v{i}") for i, c in enumerate(aggs)]
        out = [_result(c, F.col(f"f{i}") == 0, F.col(f"f{i}").cast("double"), F.lit(0.0), F.col("n"), F.col(f"f{i}"),
                       F.col(f"s{i}") if c.column else null) for i, c in enumerate(rows)]
        for i, c in enumerate(aggs):
            ok = F.coalesce(between(F.col(f"v{i}"), c.low, c.high), F.lit(True))
            limit = c.high if c.high is not None else c.low
            out.append(_result(c, ok, F.col(f"v{i}"), F.lit(float(limit)), F.col("n"),
                               F.when(ok, 0).otherwise(1).cast("bigint"), F.when(~ok, F.col(f"v{i}").cast("string"))))
        parts.append(df.agg(*measured).select(F.explode(F.array(*out)).alias("r")).select("r.*"))
    for c in frames:
        bad = c.frame(df)
        sample = F.min(F.col(c.column).cast("string")) if c.column in bad.columns else F.max(null)
        counted = bad.agg(F.count(F.lit(1)).alias("f"), sample.alias("s"))
        counted = counted.withColumn("n", df.agg(F.count(F.lit(1))).scalar())
        parts.append(counted.select(_result(c, F.col("f") == 0, F.col("f").cast("double"), F.lit(0.0), F.col("n"),
                                            F.col("f"), F.col("s")).alias("r")).select("r.*"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    at = F.current_timestamp() if checked_at is None else F.lit(checked_at).cast("timestamp")
    return out.select(F.lit(table).alias("table_name"), "*", at.alias("checked_at"), F.lit(run_id).alias("job_run_id"))


def _result(c: Check, passed: Column, value: Column, threshold: Column, n: Column, bad: Column, sample: Column) -> Column:
    return F.struct(F.lit(c.name).alias("check_name"), F.lit(c.column).alias("column_name"), F.lit(c.kind).alias("check_type"),
                    F.lit(c.severity).alias("severity"), passed.alias("passed"), value.alias("value"),
                    threshold.alias("threshold"), n.alias("row_count"), bad.cast("bigint").alias("failed_count"),
                    sample.alias("sample_failures"))


def record_results(results: DataFrame, path: str) -> None:
    """Append suite results to the quality table, one folder per month of the check."""
    (results.withColumn("month", F.date_format("checked_at", "yyyyMM"))
     .write.mode("append").partitionBy("month").parquet(path))


def suite_status(results: DataFrame) -> DataFrame:
    """error when an ERROR test failed, warn when only WARN tests failed, else pass."""
    errors = F.count_if(~F.col("passed") & (F.col("severity") == "ERROR"))
    warns = F.count_if(~F.col("passed") & (F.col("severity") == "WARN"))
    return (results.groupBy("table_name").agg(F.count(F.lit(1)).alias("tests"), errors.alias("errors"), warns.alias("warnings"))
            .withColumn("status", F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warn").otherwise("pass")))
