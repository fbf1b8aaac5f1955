"""Exact duplicates by a tree merge of sorted digest runs.

Method: the rows of neighbouring input partitions make a run: their digests in
ascending order, equal ones folded into one entry with the smallest of their
identifiers and the group's size. Runs are exchanged in binomial rounds. In a
round, each run and its partner split the digests between them into twice as
many slices as before, and the slices of the two runs that have the same digests
meet in one partition: they are merged in sorted order, and equal neighbours fold
again. After log2(runs) rounds there is one run, its slices spread over the
cluster, with one entry per distinct text. Entries fold only if length and a
second, independent hash agree too, at every level. Hot texts are folded where
they are read, so a text sends one entry per task. Groups too large for one task
of a join reach their rows as a broadcast of at most `1000` entries. DataFrame
functions only.

Defined results: null counts as the empty text; of equal texts the row with
the most code points stays, then the smallest id, a null id after all others,
then the first row; of repeated rows one stays; an empty table gives an empty
result; other columns are ignored or, where rows are dropped, carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE_SPACE, materialize, pick, prepare

KEYS = ["digest", "check", "length"]
HOT_GROUPS = 1000
RUNS = 16


def _digested(text):
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")
    return {"digest": F.unhex(F.sha2(bare, 256)), "check": F.xxhash64(bare), "length": F.char_length(bare),
            "points": F.coalesce(F.char_length(text), F.lit(0))}


def _slice(bits: int):
    """The first bits of a digest, 16 at most."""
    return F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - bits)


def _merge_runs(rows: DataFrame, runs: int) -> DataFrame:
    """(digest, check, length, best, group_size): one entry per distinct text after all rounds."""
    rounds = max(0, runs - 1).bit_length()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # slices of all runs together are some for each partition
    spare = min(16 - rounds, max(0, (4 * parts).bit_length() - rounds))
    best = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    level = (rows.select((F.spark_partition_id() % runs).alias("run"), _slice(spare).alias("slice"), *KEYS, best.alias("best"))
             .groupBy("run", "slice", *KEYS).agg(F.min("best").alias("best"), F.count(F.lit(1)).alias("group_size")))
    for number in range(1, rounds + 1):
        met = level.select(F.shiftright("run", 1).alias("run"), _slice(spare + number).alias("slice"), *KEYS, "best", "group_size")
        merged = met.repartition(parts, "run", "slice").sortWithinPartitions("run", "slice", *KEYS)
        # rows come in the order of the keys, so equal ones are neighbours of one sorted stream
        level = merged.groupBy("run", "slice", *KEYS).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
    return level.drop("run", "slice")


def _decisions(docs: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    prepare(docs.sparkSession)
    source = pick(docs, doc_id=id_col, text=text_col)
    rows = materialize(source.select("doc_id", F.monotonically_increasing_id().alias("row"),
                                     *(c.alias(n) for n, c in _digested(F.col("text")).items())), "digests")
    entries = materialize(_merge_runs(rows, runs), "entries")
    share = rows.count() / HOT_GROUPS
    hot = F.broadcast(entries.where(F.col("group_size") > share))  # fewer than HOT_GROUPS entries
    joined = rows.join(hot, KEYS).unionByName(
        rows.join(hot.select(*KEYS), KEYS, "left_anti").join(entries.where(F.col("group_size") <= share), KEYS))
    return joined.withColumn("kept", F.col("row") == F.col("best.row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; texts are equal when they differ in white space alone."""
    return _decisions(docs, id_col, text_col, runs).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS) -> DataFrame:
    """The rows that stay, with all their columns. Rows equal in id and text count as one."""
    decided = _decisions(docs, id_col, text_col, runs)
    same_id = decided.where("not kept and doc_id <=> best.doc_id and points = -best.points")
    lower = [c.lower() for c in docs.columns]
    id_at, text_at = (docs.columns.index(c) if c in docs.columns else lower.index(c.lower()) for c in (id_col, text_col))
    names = [f"_c{i}" for i in range(len(lower))]
    rows = docs.toDF(*names).withColumns(_digested(F.col(f"_c{text_at}")))
    stay = decided.where("kept").select(F.col("doc_id").alias("stay_id"), *(F.col(c).alias(f"stay_{c}") for c in (*KEYS, "points")))
    match = F.col(f"_c{id_at}").eqNullSafe(F.col("stay_id"))
    for c in (*KEYS, "points"):
        match = match & (F.col(c) == F.col(f"stay_{c}"))
    kept = rows.join(stay, match, "left_semi")
    if not same_id.isEmpty():
        kept = kept.dropDuplicates([f"_c{id_at}", *KEYS])
    return kept.select(*names).toDF(*docs.columns)
