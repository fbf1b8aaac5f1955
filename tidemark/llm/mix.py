"""Mixing sources to target weights by Poisson replication.

Method: a source's target share of the mixture divided by its present size is
the mean rate at which its documents repeat. A document's number of copies is
the inverse of the Poisson distribution with that mean at a point that a hash
of seed and document id picks; documents are exploded by their counts and
shuffled globally by a second hash. DataFrame functions only.

Defined results: sources not named in the weights, null among them, form one
group with the weight `other`; a group without size has rate 0; a null id is
replaced by the digest of the text in the hash; rows equal in id repeat
equally often; an empty table gives an empty result; columns of the documents
called like the operator's own ones are replaced by them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, prepare

# A Poisson variable with a large mean is drawn as the sum of independent ones
# with a mean up to this, which keeps the inversion table short and exact.
DRAW_MEAN = 32.0
_STEPS = math.ceil(DRAW_MEAN + 12 * math.sqrt(DRAW_MEAN) + 20)
_OTHER = "\u0000other"


def unit_hash(*parts: Column) -> Column:
    """A point strictly between 0 and 1 from the first 52 bits of an md5."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... as an array; ends where nothing is left in double precision."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("sums"))

    def step(state, k):
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), zero, step, lambda state: state["sums"])


def repetition_rates(docs: DataFrame, weights: Mapping[str, float], other: float, epochs: float,
                     source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(mix_group, size, rate, draws, table), one row per named source and one for all others.

    Size is in characters. Rates add up to `epochs` times the present size.
    """
    total_weight = float(sum(weights.values()) + other)
    if total_weight <= 0 or other < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights are non-negative and not all zero")
    rows = pick(docs, source=source_col, text=text_col)
    share = F.coalesce(*(F.when(F.col("mix_group") == s, F.lit(w / total_weight)) for s, w in weights.items()),
                       F.lit(other / total_weight)) if weights else F.lit(other / total_weight)
    sizes = (rows.select(_group(F.col("source"), weights).alias("mix_group"),
                         F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"))
             .groupBy("mix_group").agg(F.sum("size").alias("size")))
    whole = sizes.agg(F.sum("size")).scalar()
    rate = F.when(F.col("size") > 0, share * epochs * whole / F.col("size")).otherwise(0.0)
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / DRAW_MEAN)).cast("int")
    return (sizes.select("mix_group", "size", rate.alias("rate"))
            .withColumn("draws", draws).withColumn("table", poisson_table(F.col("rate") / F.col("draws"))))


def _group(source: Column, weights: Mapping[str, float]) -> Column:
    if not weights:
        return F.lit(_OTHER)
    return F.when(source.isin(*weights), source).otherwise(F.lit(_OTHER))


def mix_sources(docs: DataFrame, weights: Mapping[str, float], other: float = 0.0, epochs: float = 1.0,
                seed: int = 42, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """All columns of the documents with `mix_rate`, `mix_copy` (1, 2, ...) and `mix_key`, in random order.

    `weights` are target shares of the mixture in characters by source, `other`
    is the share of all sources not named, `epochs` the size of the mixture as
    a multiple of the input. Rows are spread over the partitions by `mix_key`
    and sorted by it inside them.
    """
    spark = prepare(docs.sparkSession)
    rates = repetition_rates(docs, weights, other, epochs, source_col, text_col)
    lower = [c.lower() for c in docs.columns]

    def at(name):
        return F.col(f"_c{docs.columns.index(name) if name in docs.columns else lower.index(name.lower())}")

    own = ("mix_rate", "mix_copy", "mix_key")
    name = F.coalesce(at(id_col).cast("string"), F.md5(F.coalesce(at(text_col), F.lit("")).cast("binary")))
    rows = docs.toDF(*(f"_c{i}" for i in range(len(lower)))).withColumns(
        {"mix_group": _group(at(source_col), weights), "mix_name": name})
    count = F.aggregate(
        F.sequence(F.lit(1), F.col("draws")), F.lit(0),
        lambda total, draw: total + F.size(F.filter(
            F.col("table"), lambda p: p < unit_hash(F.lit(f"{seed}"), draw.cast("string"), F.col("mix_name")))))
    # The broadcast table has one row per weight and one more.
    copies = (rows.join(F.broadcast(rates.select("mix_group", "draws", "table", F.col("rate").alias("mix_rate"))), "mix_group")
              .withColumn("mix_count", count).where("mix_count > 0")
              .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))
              .withColumn("mix_key", F.md5(F.concat_ws("|", F.lit(f"{seed}"), F.lit("order"), F.col("mix_name"),
                                                       F.col("mix_copy").cast("string"))))
              # Rows that repeat under one id have one key; the second one spreads them.
              .withColumn("mix_spread", F.monotonically_increasing_id() % 64))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in own]
    return (copies.select(*(f"_c{i}" for i in range(len(lower))), *own, "mix_spread")
            .repartition(parts, "mix_key", "mix_spread").sortWithinPartitions("mix_key").select(*kept, *own))
