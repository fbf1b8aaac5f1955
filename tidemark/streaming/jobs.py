"""Continuous versions of the load and roll-up jobs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .logs import HistoryLog, RollupLog, SumLog, UpsertLog, each_batch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep operator state in RocksDB: its size is bounded by disk, not by executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
                max_bytes: str | None = None) -> DataFrame:
    """New parquet files of a folder; files or bytes per batch bound the size of one batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.parquet(path)


def _start(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _checkpoint(given: str | None, path: str) -> str:
    """A table's own checkpoint unless one is given, so a later run goes on where the last one stopped."""
    return given or f"{path.rstrip('/')}/_checkpoint"


def stream_ingest(stream: DataFrame, path: str, checkpoint: str | None = None, every: str | None = None,
                  partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append a stream to a table in batches, exactly once, over any number of runs.

    A table has one source and one checkpoint: the file sink skips batch
    numbers it knows, so a second checkpoint on the same table would lose rows.
    Another source under the same checkpoint is an error.
    """
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _start(writer, _checkpoint(checkpoint, path), every)


def stream_upsert(stream: DataFrame, target: UpsertLog, checkpoint: str | None = None,
                  every: str | None = None) -> StreamingQuery:
    """Merge each micro-batch by key."""
    checkpoint = _checkpoint(checkpoint, target.path)
    return _start(stream.writeStream.foreachBatch(each_batch(target.apply, checkpoint)), checkpoint, every)


def incremental_rollup(stream: DataFrame, target: SumLog | RollupLog, checkpoint: str | None = None,
                       every: str | None = None) -> StreamingQuery:
    """Add each micro-batch's partial totals."""
    checkpoint = _checkpoint(checkpoint, target.path)
    return _start(stream.writeStream.foreachBatch(each_batch(target.apply, checkpoint)), checkpoint, every)


def stream_dedupe(stream: DataFrame, keys: Sequence[str], time_column: str, delay: str) -> DataFrame:
    """First delivery of each key; keys are remembered for `delay` of event time."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_trend(stream: DataFrame, time_column: str, grain: str, delay: str, measures: Mapping[str, Column],
                 group_by: Sequence[str] = ()) -> DataFrame:
    """Tumbling hour or day aggregates; rows later than `delay` are dropped."""
    window = F.window(time_column, f"1 {grain}")
    return (stream.withWatermark(time_column, delay).groupBy(window, *group_by)
            .agg(*[c.alias(n) for n, c in measures.items()])
            .select(F.col("window.start").alias("time_period"), *group_by, *measures))


def stream_trend_table(stream: DataFrame, target: UpsertLog, checkpoint: str | None = None,
                       every: str | None = None) -> StreamingQuery:
    """Keep the newest state of each window in a table (update mode)."""
    checkpoint = _checkpoint(checkpoint, target.path)
    return _start(stream.writeStream.outputMode("update").foreachBatch(each_batch(target.apply, checkpoint)), checkpoint, every)


def stream_scd2(stream: DataFrame, target: HistoryLog, checkpoint: str | None = None,
                every: str | None = None) -> StreamingQuery:
    """Log a change feed whose history `target.read()` gives; a batch costs its own size, late changes find their place."""
    checkpoint = _checkpoint(checkpoint, target.path)
    return _start(stream.writeStream.foreachBatch(each_batch(target.apply, checkpoint)), checkpoint, every)


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an available-now query; its failure is raised here."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
