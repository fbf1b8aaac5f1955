"""Training of n-gram classifiers whose indicators are scaled by naive Bayes log-count ratios.

A model is fitted on at most `max_rows` labelled documents, picked by a hash of
their id. Feature counts are taken on the executors; the driver gets the
`size` most telling features and, for each sampled document, which of those it
has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, pick, prepare

MAX_ROWS = 20_000
BUCKET_BITS = 22
SIZE = 16_384
SMOOTHING = 1.0

# A featurizer takes texts and yields, for each one, arrays of bucket numbers;
# their union is the set of the text's n-grams.
Featurize = Callable[[list[str]], Iterator[Iterator[np.ndarray]]]


@dataclass
class Selected:
    """Chosen buckets in ascending order with their log-count ratios."""

    buckets: np.ndarray
    ratios: np.ndarray


@dataclass
class Linear:
    """A fitted model: score = 1 / (1 + exp(-(slope * (weights of the features + bias) + shift)))."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, id_col: str = "doc_id",
                    text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most `max_rows` labelled documents that `keep` (over doc_id) admits.

    Of labels that contradict each other the larger one counts, of texts with
    one id the smallest.
    """
    known = (pick(labels, doc_id=id_col, label=label_col).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
             .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    order = F.xxhash64("doc_id")
    # Of many labels only those with a small hash are sorted: some more than are wanted.
    share = 1.5 * max_rows / max(1, known.count())
    few = known.where(order % (1 << 30) < int(min(share, 1.0) * 2 ** 31) - 2 ** 30) if share < 1 else known
    chosen = F.broadcast(few.orderBy(order % (1 << 30), order, "doc_id").limit(max_rows))
    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")), "sample")


def count_features(sample: DataFrame, featurize: Featurize, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(bucket, n0, n1): documents of either class that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bucket_bits), np.int32)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            for label, parts in zip(labels, featurize(batch.column(1).to_pylist())):
                found = [np.unique(p) for p in parts]
                if found:
                    counts[label][np.unique(np.concatenate(found))] += 1
        seen = np.flatnonzero(counts.any(axis=0))
        for at in range(0, len(seen), 100_000):
            some = seen[at:at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0][some], pa.int64()),
                                              pa.array(counts[1][some], pa.int64())], ["bucket", "n0", "n1"])

    return (sample.select("label", "text").mapInArrow(run, "bucket int, n0 long, n1 long")
            .groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def select_features(counts: DataFrame, totals: tuple[int, int], size: int = SIZE, min_docs: int = 3) -> Selected:
    """The `size` buckets whose log-count ratio is largest against its noise; documents seen weigh by their root."""
    n0, n1 = (F.col(c) + SMOOTHING for c in ("n0", "n1"))
    ratio = F.log(n1 / (totals[1] + 2 * SMOOTHING)) - F.log(n0 / (totals[0] + 2 * SMOOTHING))
    seen = F.col("n0") + F.col("n1")
    rows = (counts.where(seen >= min_docs)
            .select("bucket", ratio.alias("ratio"), (F.abs(ratio) * F.sqrt(seen)).alias("worth"))
            .orderBy(F.desc("worth"), "bucket").limit(size).toArrow().sort_by("bucket"))
    return Selected(rows["bucket"].to_numpy().astype(np.int64), rows["ratio"].to_numpy())


def _dense(buckets: np.ndarray, values: np.ndarray, bucket_bits: int, kind) -> np.ndarray:
    table = np.zeros(1 << bucket_bits, kind)
    table[buckets] = values
    return table


def present(parts: Iterator[np.ndarray], numbers: np.ndarray) -> np.ndarray:
    """Distinct selected features of a text; `numbers` has feature number + 1 by bucket, 0 for the others."""
    found = [np.unique(hit[hit > 0]) for hit in (numbers[p] for p in parts)]
    return np.unique(np.concatenate(found)) - 1 if found else np.empty(0, np.int64)


def training_rows(sample: DataFrame, featurize: Featurize, selected: Selected,
                  bucket_bits: int = BUCKET_BITS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and feature numbers of the sample, in order of doc_id."""
    numbers = sample.sparkSession.sparkContext.broadcast(
        _dense(selected.buckets, np.arange(1, len(selected.buckets) + 1), bucket_bits, np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [present(parts, numbers.value).astype(np.int32).tobytes() for parts in featurize(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                                             ["doc_id", "label", "features"])

    kind = dict(sample.dtypes)["doc_id"]
    rows = (sample.select("doc_id", "label", "text").mapInArrow(run, f"doc_id {kind}, label int, features binary")
            .toArrow().sort_by("doc_id"))
    return rows["label"].to_numpy().astype(np.int64), [np.frombuffer(x.as_buffer(), np.int32) for x in rows["features"]]


def _scorer(docs: DataFrame, featurize: Featurize, model: Linear, bucket_bits: int) -> Callable[[pa.Array], np.ndarray]:
    # arrays alone: a broadcast names classes by their module, which workers need not have
    shared = docs.sparkSession.sparkContext.broadcast(
        (_dense(model.buckets, np.arange(1, len(model.buckets) + 1), bucket_bits, np.int32), np.asarray(model.weights, float)))
    bias, slope, shift = float(model.bias), float(model.slope), float(model.shift)

    def scores(texts: pa.Array) -> np.ndarray:
        numbers, weights = shared.value
        margins = [weights[present(parts, numbers)].sum() + bias for parts in featurize([t or "" for t in texts.to_pylist()])]
        return 1 / (1 + np.exp(-np.clip(slope * np.array(margins, float) + shift, -500, 500)))

    return scores


def score_texts(rows: DataFrame, featurize: Featurize, model: Linear, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(doc_id, score) of all rows (doc_id, text)."""
    scores = _scorer(rows, featurize, model, bucket_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)))], ["doc_id", "score"])

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def keep_texts(docs: DataFrame, featurize: Featurize, model: Linear, threshold: float, text_col: str = "text",
               bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """The rows whose text scores at least `threshold`, with all their columns."""
    prepare(docs.sparkSession)
    scores = _scorer(docs, featurize, model, bucket_bits)
    lower = [c.lower() for c in docs.columns]
    at = docs.columns.index(text_col) if text_col in docs.columns else lower.index(text_col.lower())
    rows = docs.toDF(*(f"_c{i}" for i in range(len(lower))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) >= threshold))

    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def feature_training(docs: DataFrame, labels: DataFrame, label_col: str, keep: Column, featurize: Featurize, size: int,
                     max_rows: int, id_col: str, text_col: str):
    """Sample, choose features and return (selected, labels, feature numbers of each row)."""
    sample = labelled_sample(docs, labels, label_col, keep, id_col, text_col, max_rows)
    seen = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = (seen.get(0, 0), seen.get(1, 0))
    selected = select_features(count_features(sample, featurize), totals, size)
    return selected, *training_rows(sample, featurize, selected)
