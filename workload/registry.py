"""Registry of (query, oracle SQL) pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, tuple[int, ...]] = {}
MODULE_OF: dict[str, str] = {}


class Tables:
    """Lazy access to the parquet tables of one scale factor."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, ops: list[int], sql: str | None = None):
    """Register `fn(tables) -> DataFrame` under `name` with its oracle."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        OPERATORS[name] = tuple(ops)
        MODULE_OF[name] = fn.__module__
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load_all() -> None:
    import importlib

    for module in ("semantic", "filters", "joins", "aggregates", "windows", "reshape", "scalars",
                   "calendars", "sources", "models", "quality", "charts", "streams", "loadtest"):
        try:
            importlib.import_module(f"workload.{module}")
        except ModuleNotFoundError as missing:
            if missing.name != f"workload.{module}":
                raise
