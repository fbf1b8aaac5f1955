"""Helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize
from tidemark.session import prepare as prepare_session

BATCH_BYTES = 4 << 20
HOT_GROUPS = 1000
CHUNK_ROWS = 1 << 17
MOST_BROADCAST = 200_000  # rows that the planner may broadcast

# The white space of the text contracts: space and U+0009 to U+000D.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: Python gets its batches by bytes, so long texts don't pile up."""
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Columns `new=old` of a frame, whatever its other columns are called.

    Of columns with the same name the first one counts; names match exactly
    first, then without regard to case.
    """
    prepare(df.sparkSession)
    lower = [c.lower() for c in df.columns]
    numbered = df.toDF(*(f"_c{i}" for i in range(len(lower))))
    at = {new: df.columns.index(old) if old in df.columns else lower.index(old.lower())
          for new, old in wanted.items()}
    return numbered.select(*(F.col(f"_c{i}").alias(new) for new, i in at.items()))


def per_process(kind: str, key, make: Callable):
    """A value made once per process and kept until another one of its kind is asked for, such as a loaded tokenizer."""
    kept = sys.__dict__.setdefault("_tidemark_kept", {})
    if kind not in kept or kept[kind][0] != key:
        kept.pop(kind, None)
        kept[kind] = (key, make())
    return kept[kind][1]


class SharedTable:
    """A small frame sent to all executors as Arrow bytes; each process makes of it what it needs."""

    def __init__(self, df: DataFrame, order: list[tuple[str, str]] | None = None):
        table = df.toArrow()
        self.rows = table.num_rows
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table.sort_by(order) if order else table)
        self.key = uuid.uuid4().hex
        self.sent = df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())

    def made(self, kind: str, make: Callable[[pa.Table], object]):
        """`make` of the table, remembered per process."""
        return per_process("shared table", (self.key, kind), lambda: make(pa.ipc.open_stream(self.sent.value).read_all()))


def crc_remainder(column, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def vocabulary(texts: DataFrame, split: Callable[[str], list], kind: str = "string",
               held: int = 300_000) -> DataFrame:
    """Distinct words and their counts over the column `text` of all rows.

    A task counts in a table of about `held` words before it hands them on, so
    hot words reach the shuffle already added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.string() if kind == "string" else pa.binary()

        def out(seen):
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), kinds), pa.array(seen.values(), pa.int64())], ["word", "n"])

        seen = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    seen.update(split(text))
                    if len(seen) >= held:
                        yield out(seen)
                        seen = Counter()
        if seen:
            yield out(seen)

    return (texts.select("text").mapInArrow(run, f"word {kind}, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def most_frequent(words: DataFrame, size: int) -> DataFrame:
    """The most frequent words (columns word, n, ...), as many as fit into `size` without parting words of near counts.

    Counts of counts, by steps of a sixteenth of a power of two, say which
    count is the least; no more than `size` rows come out, whatever the input.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    held, least = 0, None
    for row in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if held + row["count"] > size:
            break
        held, least = held + row["count"], row.step
    return words.where(step >= least) if least is not None else words.limit(0)


def merged(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that is merged, never broadcast, unless both sides have few rows, `rows` at most.

    The planner takes an exploded table for as small as its file, and a file of
    few distinct values for as small as it is packed.
    """
    return side.hint("merge") if rows > MOST_BROADCAST else side


def join_groups(rows: DataFrame, entries: DataFrame, keys: list[str], sizes: DataFrame, total: int) -> DataFrame:
    """Inner join of rows with one entry per key, where a few keys may hold most rows.

    `sizes` has the keys and their rows `n`, `total` is the sum. Keys with over
    a thousandth of the rows are fewer than a thousand: their entries are
    broadcast, so their rows stay where they are. All others meet by a shuffle,
    of many rows in any case.
    """
    hot = sizes.where(F.col("n") > total / HOT_GROUPS).select(*keys)
    hot_entries = F.broadcast(entries.join(F.broadcast(hot), keys))
    cold = entries.join(F.broadcast(hot), keys, "left_anti")
    return rows.join(hot_entries, keys).unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(merged(cold, total), keys))


def placed(df: DataFrame, group: Sequence[str], order: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows, stored, with their place `pos` (from 0) in their group's ascending order and the group's size `n`.

    `order` ends with a stored row number, so no two rows are equal and a group
    of any size, also of equal rows, spreads over range partitions. Summaries
    have one row per group and partition.
    """
    chunks = max(1, -(-df.count() // chunk_rows))
    ranged = df.repartitionByRange(chunks, *group, *order).sortWithinPartitions(*group, *order)
    stored = materialize(ranged.select("*", F.spark_partition_id().alias("_chunk"), F.monotonically_increasing_id().alias("_at")), "placed")
    counts = stored.groupBy(*group, "_chunk").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("_chunk").alias("_in"), "_first",
                           F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"), F.sum("_count").over(whole).alias("n"))
    match = F.col("_chunk") == F.col("_in")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return stored.join(counts, match).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("pos"), "n")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows whose first `keys` columns are equal, each as one table; the caller has sorted by them and bounds a run."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for column in batch.columns[:keys]:
            codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for first, end in zip(starts, starts[1:]):
            key = tuple(column[first].as_py() for column in batch.columns[:keys])
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = key
            held.append(batch.slice(first, end - first))
    if held:
        yield current, pa.Table.from_batches(held)


__all__ = ["BATCH_BYTES", "HOT_GROUPS", "SharedTable", "WHITE_SPACE", "crc_remainder", "grouped", "join_groups", "materialize", "merged", "most_frequent", "per_process",
           "pick", "placed", "prepare", "vocabulary"]
