"""Reading tables, queries and files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARAMETER = re.compile(r"\{\{\s*(\w+)\s*\}\}")


def project_columns(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """The named columns that exist, in the given order."""
    if not columns:
        return df
    return df.select(*[c for c in columns if c in df.columns])


def lowercase_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Full extract of a parquet table; only the wanted columns are scanned."""
    return project_columns(spark.read.parquet(path), columns)


def read_jdbc(spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
              columns: Sequence[str] | None = None, split: tuple[str, Any, Any, int] | None = None,
              properties: Mapping[str, str] | None = None, fetchsize: int = 10_000) -> DataFrame:
    """A database table or query; `split` = (column, low, high, partitions) reads in parallel."""
    if (table is None) == (query is None):
        raise ValueError("give a table or a query")
    source = table if table is not None else f"({query}) q"
    reader = spark.read.format("jdbc").options(url=url, dbtable=source, fetchsize=fetchsize, **(properties or {}))
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts)
    return project_columns(reader.load(), columns)


def read_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """A custom SELECT; keyword frames are visible in it as `{name}`."""
    return spark.sql(sql, **views)


def run_parameterized(spark: SparkSession, sql: str, params: Mapping[str, Any], **views: DataFrame) -> DataFrame:
    """Bind `{{name}}` as typed SQL parameters; values never become SQL text. Views live for this text only."""
    missing = [p for p in _PARAMETER.findall(sql) if p not in params]
    if missing:
        raise KeyError(f"no value for parameters {missing}")
    text = _PARAMETER.sub(lambda m: f":{m.group(1)}", sql)
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(text, args=dict(params))
    finally:
        for name in views:
            spark.catalog.dropTempView(name)


def _after_head(lines: int):
    """Rows (line, file) without the first `lines` of each file; a file's rows come in order and together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(1).dictionary_encode()
            codes = names.indices.to_numpy()
            new = np.concatenate([[names[0].as_py() != file], codes[1:] != codes[:-1]])
            at = np.arange(len(codes))
            first = np.maximum.accumulate(np.where(new, at, -1))  # where a row's file begins, -1 in an earlier batch
            place = np.where(first < 0, at + seen, at - first)
            file, seen = names[len(codes) - 1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(place >= lines))], ["line"])

    return run


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, delimiter: str = ",",
             encoding: str = "UTF-8", header_row: int | None = 0, na_values: Sequence[str] = ("",),
             multi_line: bool = False) -> DataFrame:
    """Delimited text with a declared schema; a row of another width is an error.

    `header_row` counts the lines before the header; None means no header.
    Lines to skip are counted within each file, whose head must lie in its
    first split; only first splits go through that count, later ones are parsed
    as they come. Such files can't have line breaks inside fields. `multi_line`
    allows those otherwise. Several NA markers become NULL.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text_schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    reader = spark.read.option("sep", delimiter).option("encoding", encoding).option("mode", "FAILFAST")
    if header_row:
        if multi_line:
            raise ValueError("lines can be skipped or lie inside fields, not both")
        # a separator that no text has: each line arrives as one decoded column
        lines = (spark.read.option("sep", "\u0001").option("quote", "").option("encoding", encoding)
                 .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).schema("line string").csv(path)
                 .select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))
        heads = lines.filter("start = 0").select("line", "file").mapInArrow(_after_head(header_row + 1), "line string")
        body = None
        for part in (heads, lines.filter("start > 0").select("line")):
            parsed = part.select(F.from_csv("line", ", ".join(f"`{f.name}` string" for f in schema.fields),
                                            {"sep": delimiter, "mode": "FAILFAST"}).alias("r")).select("r.*")
            body = parsed if body is None else body.unionByName(parsed)
    else:
        body = (reader.option("header", header_row is not None).option("multiLine", multi_line)
                .schema(text_schema).csv(path))
    marks = list(na_values)
    return body.select(*[
        F.when(F.col(f.name).isin(marks), None).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    return read_csv(spark, path, schema, delimiter="\t", **options)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Files that each hold one JSON document: an array of records."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Newline-delimited JSON; give a schema to avoid the inference pass."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return project_columns(spark.read.option("mergeSchema", True).parquet(path), columns)


def _gunzip_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of whole files, unpacked where they are gzip; a part of a file at a time."""
    for batch in batches:
        for content in batch["content"]:
            unpack = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None
            rest = b""
            for at in range(0, len(content), 1 << 20):
                piece = content[at:at + (1 << 20)]
                *lines, rest = (rest + (unpack.decompress(piece) if unpack else piece)).split(b"\n")
                yield pd.DataFrame({"line": [x.decode("utf-8") for x in lines if x.strip()]})
            if rest.strip():
                yield pd.DataFrame({"line": [rest.decode("utf-8")]})


def _glob(spark: SparkSession, pattern: str) -> tuple[list[str], list[str]]:
    """Files of a glob that Spark reads by their name, and those whose suffix lies about gzip; two bytes of each are read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    honest, odd = [], []
    for found in files.globStatus(where) or []:
        stream = files.open(found.getPath())
        try:
            packed = (stream.read(), stream.read()) == (0x1F, 0x8B)
        finally:
            stream.close()
        name = found.getPath().toString()
        (honest if packed == name.endswith(".gz") else odd).append(name)
    return honest, odd


def read_jsonl_glob(spark: SparkSession, pattern: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of every file of a glob, gzip or plain whatever the suffix; a malformed line is an error.

    Fields missing in some files are NULL: the union of the files' schemas is
    the declared one. Lines end at a line feed only. Spark's own reader takes
    the files whose suffix tells what they are; only the others pass Python.
    """
    honest, odd = _glob(spark, pattern)
    parts = []
    if honest:
        parts.append(spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(honest))
    if odd:
        ddl = schema if isinstance(schema, str) else schema.simpleString()
        lines = spark.read.format("binaryFile").load(odd).select("content").mapInPandas(_gunzip_lines, "line string")
        parts.append(lines.select(F.from_json("line", ddl, {"mode": "FAILFAST"}).alias("r")).select("r.*"))
    if not parts:
        raise FileNotFoundError(f"no file matches {pattern}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First n rows with non-native values as text."""
    native = (T.NumericType, T.BooleanType, T.StringType)
    return df.limit(n).select(*[
        F.col(f.name) if isinstance(f.dataType, native) else F.col(f.name).cast("string").alias(f.name)
        for f in df.schema.fields])


def dataset_preview(spark: SparkSession, source: DataFrame | str, limit: int = 100) -> DataFrame:
    """First `limit` rows of a physical table (frame) or virtual dataset (SQL text)."""
    if limit < 1:
        raise ValueError("a preview has at least one row")
    return (spark.sql(source) if isinstance(source, str) else source).limit(limit)
