"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, merged


def _hang_on_least(near: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """Every far end of `links` (u, v), `most` at most, hangs on the least neighbour of u in `near`, u itself included."""
    least = near.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    return links.join(merged(least, most), "u")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the least node of its component.

    Large-star and small-star rounds in turn until nothing changes. Neighbours
    are never gathered: a round needs their least one only, which is added up
    before the shuffle. Each round is written to the shared folder. Links are
    counted in every round, so many of them are merged, never broadcast.
    """
    # Every link goes from the larger to the smaller node.
    current = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                          .where("u <> v").distinct(), "links")
    state = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, most = now, 2 * now[0]
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_hang_on_least(both, both, most).where("v > u")
                 .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct())
        hung = _hang_on_least(large, large, most)
        small = hung.select(F.explode(F.array(F.struct("u", F.col("least").alias("v")),
                                              F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("x"))
        current = materialize(small.select("x.u", "x.v").where("u <> v").distinct(), "links")
