"""Corpus pipeline: documents to token ids in five stages, each one calling an operator of `tidemark.llm`.

Each stage works on all rows its predecessor kept. `run` writes every stage's
result to the shared folder and reads it again, so a lost executor costs one
stage at most.

Defined results: a null text counts as empty in every stage. The quality stage
scores rows one by one, so repeated rows stay or go together; the two dedup
stages keep one row of each group, a null id after all others; the mixing stage
repeats rows under their own id, and names rows without an id by their text; the
encoding stage returns one row for each row it gets. Columns beside those of
documents are carried along to the last stage. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, mix, quality, simhash
from tidemark.llm.common import crc_remainder, materialize, prepare

QUALITY_THRESHOLD = 0.7
SHINGLE_WORDS = 4
MAX_BITS = 4
# Target shares of the mixture by source, in characters; all other sources share MIX_OTHER.
MIX_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05, "src4": 0.05}
MIX_OTHER = 0.50
MIX_EPOCHS = 1.0
MIX_SEED = 42
TOKENIZER = "word_bpe_49k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels held out of training stay out."""
    labels = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.train_quality(docs, labels, crc_remainder(F.col("doc_id"), 4) != 2)
    return quality.keep_quality(docs, model, QUALITY_THRESHOLD)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, distance=MAX_BITS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated and shuffled so that sources have their target shares."""
    return mix.mix_sources(docs, MIX_WEIGHTS, MIX_OTHER, MIX_EPOCHS, MIX_SEED).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text they decode to."""
    return bpe.bpe_digests(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# Classifier, fingerprints and tokenizer have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    result = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        result = stage(spark, result, sf_dir)
        if i < len(STAGES) - 1:
            result = materialize(result, name)
    return result
