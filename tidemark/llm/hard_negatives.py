"""Hard negatives for contrastive training, by slot-decomposed selection.

Method: an anchor's positives are the rows of its label that score highest.
Each positive admits negatives with scores in a window below its own score, and
the windows of one anchor overlap. Their upper limits cut the scores into
disjoint slots. A task keeps the best few rows of every slot (a combiner), tasks'
lists meet by a shuffle, and for each anchor the lists are merged from the lowest
slot up: as slots do not overlap, the best rows at or below a limit are those of
its slot, then those of the slots below. One such suffix answers each window; rows
under the window's lower limit are cut off its end.

Anchors go by blocks of `anchor_rows`. A block is broadcast as bytes, so its size
is bounded whatever the table's; every block is compared with all rows by matrix
products, once for positives and once for negatives. What leaves a task is a
few rows per anchor and slot.

Components are scaled and rounded down to integers, so scores are exact: matrix
products of doubles where all sums stay below 2^53, else of 64-bit integers.

Defined results: rows with a null id, label or vector, an empty vector, a null or
non-finite component, or one of 2^26 or more after scaling, take no part; vectors
of different length do not meet; higher scores come first, then smaller ids, then
earlier rows; repeated rows are rows of their own, and each repeated anchor
returns its own results; an empty window returns nothing; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SharedTable, materialize, pick, placed
from tidemark.llm.vectors import as_float_arrays, by_length, packed

ANCHOR_ROWS = 8192
_LARGEST = 1 << 26
_CELLS = 1 << 22  # scores held at a time
_NONE = np.iinfo(np.int64).min


class Best:
    """The `keep` best (score, id, row) of every (anchor, slot): highest score, then smallest id, then first row."""

    def __init__(self, anchors: int, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.score = np.full((anchors * slots, keep), _NONE, np.int64)
        self.id, self.row = np.zeros_like(self.score), np.zeros_like(self.score)

    def least(self, slot: int) -> np.ndarray:
        """Score that a new entry of each anchor has to reach."""
        return self.score[slot::self.slots, -1]

    def add(self, anchors: np.ndarray, slot: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if not len(anchors):
            return
        place = anchors * self.slots + slot
        held = np.unique(place)
        kept = np.repeat(held, self.keep)
        place, score = np.concatenate([kept, place]), np.concatenate([self.score[held].ravel(), score])
        ids, rows = np.concatenate([self.id[held].ravel(), ids]), np.concatenate([self.row[held].ravel(), rows])
        order = np.lexsort((rows, ids, ~score, place))
        place, score, ids, rows = place[order], score[order], ids[order], rows[order]
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        rank = np.arange(len(place)) - np.repeat(start, np.diff(np.append(start, len(place))))
        some = rank < self.keep
        at = place[some], rank[some]
        self.score[at], self.id[at], self.row[at] = score[some], ids[some], rows[some]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, slot, score, id, row) of all that is kept."""
        place, rank = np.nonzero(self.score != _NONE)
        return place // self.slots, place % self.slots, self.score[place, rank], self.id[place, rank], self.row[place, rank]


def _integers(scale: int):
    """(row, id, label, anchor, vector) to rows that take part, with the scaled vector as bytes."""

    def parts(column):
        for rows, matrix in by_length(column):
            scaled = np.floor(scale * matrix.astype(np.float64))
            with np.errstate(invalid="ignore"):
                good = (np.abs(scaled) < _LARGEST).all(axis=1)  # false for what is not finite
            yield rows[good], scaled[good].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], packed(batch.num_rows, parts(batch.column(4)))],
                                             ["row", "id", "label", "anchor", "vec"])
            yield out.filter(pc.is_valid(out.column(4)))

    return run


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows, exact."""
    if not left.size or not right.size:
        return np.zeros((len(left), len(right)))
    if left.shape[1] * float(np.abs(left).max()) * float(np.abs(right).max()) < 1 << 53:
        return left.astype(np.float64) @ right.astype(np.float64).T
    return left.astype(np.int64) @ right.astype(np.int64).T


class _Anchors:
    """A block of anchors by length of vector."""

    def __init__(self, table: pa.Table):
        self.rows = table["row"].to_numpy()
        self.labels = pc.unique(table["label"])
        self.label = pc.index_in(table["label"], self.labels).to_numpy()
        values = table["vec"].to_pylist()
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        self.groups = {size: np.flatnonzero(sizes == size) for size in np.unique(sizes).tolist()}
        self.vectors = {size: np.frombuffer(b"".join(values[i] for i in at), np.int32).reshape(len(at), -1) for size, at in self.groups.items()}

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(anchors, scores, whether labels agree, ids, rows) for parts of a batch (row, id, label, vec)."""
        values = batch.column(3).to_pylist()
        sizes = np.fromiter(map(len, values), np.int64, len(values))
        label = pc.fill_null(pc.index_in(batch.column(2), self.labels), -1).to_numpy()
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for size, at in self.groups.items():
            here, step = np.flatnonzero(sizes == size), max(16, _CELLS // len(at))
            for first in range(0, len(here), step):
                some = here[first:first + step]
                matrix = np.frombuffer(b"".join(values[i] for i in some), np.int32).reshape(len(some), -1)
                yield at, _products(self.vectors[size], matrix), self.label[at][:, None] == label[some][None, :], ids[some], rows[some]


_CANDIDATES = "anchor long, slot int, score long, id long, row long"


def _candidates(rows: np.ndarray, best: Best) -> pa.RecordBatch:
    anchor, slot, score, ids, at = best.entries()
    return pa.RecordBatch.from_arrays([pa.array(rows[anchor]), pa.array(slot, pa.int32()), pa.array(score), pa.array(ids), pa.array(at)],
                                      ["anchor", "slot", "score", "id", "row"])


def _positives(block: SharedTable, keep: int):
    """Rows to the `keep` best other rows of each anchor's label that the task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.made("anchors", _Anchors)
        best = Best(len(anchors.rows), 1, keep)
        for batch in batches:
            for at, scores, same, ids, rows in anchors.scores(batch):
                same &= anchors.rows[at][:, None] != rows[None, :]
                a, r = np.nonzero(same & (scores >= best.least(0)[at][:, None]))
                best.add(at[a], 0, scores[a, r].astype(np.int64), ids[r], rows[r])
        yield _candidates(anchors.rows, best)

    return run


def _slots(anchors: _Anchors, slots: pa.Table, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor's slots; slots that do not exist hold no score."""
    low, high = np.full((len(anchors.rows), count), 1, np.int64), np.zeros((len(anchors.rows), count), np.int64)
    order = np.argsort(anchors.rows)
    at = order[np.searchsorted(anchors.rows[order], slots["anchor"].to_numpy())] if slots.num_rows else np.empty(0, np.int64)
    low[at, slots["slot"].to_numpy()], high[at, slots["slot"].to_numpy()] = slots["low"].to_numpy(), slots["high"].to_numpy()
    return low, high


def _negatives(block: SharedTable, limits: SharedTable, count: int, keep: int):
    """Rows to the `keep` best rows of another label in each anchor's slots that the task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.made("anchors", _Anchors)
        low, high = _slots(anchors, limits.made("slots", lambda t: t), count)
        best = Best(len(anchors.rows), count, keep)
        for batch in batches:
            for at, scores, same, ids, rows in anchors.scores(batch):
                for slot in range(count):
                    least = np.maximum(low[at, slot], best.least(slot)[at])
                    a, r = np.nonzero(~same & (scores >= least[:, None]) & (scores <= high[at, slot][:, None]))
                    best.add(at[a], slot, scores[a, r].astype(np.int64), ids[r], rows[r])
        yield _candidates(anchors.rows, best)

    return run


def _first(found: DataFrame, keep: int) -> DataFrame:
    """The best `keep` of every (anchor, slot) with their place from 1."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def _windows(positives: DataFrame, low: int, high: int) -> DataFrame:
    """Positives with the limits of their window, and its slot: limits of an anchor descend by slot. Empty windows go."""
    down = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100L")  # noqa: E731  a hundredth, rounded down
    at_least, at_most = -down(f"(-score * {low}L)"), down(f"(score * {high}L)")
    limits = positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                              at_least.cast("long").alias("low"), at_most.cast("long").alias("high")).where("low <= high")
    return limits.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("high"))) - 1)


def _slot_limits(windows: DataFrame) -> DataFrame:
    """(anchor, slot, low, high): each slot ends above the next one's upper limit, the last at the least lower limit."""
    lowest = F.min("low").over(Window.partitionBy("anchor"))
    slots = windows.withColumn("lowest", lowest).groupBy("anchor", "slot").agg(F.max("high").alias("high"), F.max("lowest").alias("lowest"))
    following = F.lead("high").over(Window.partitionBy("anchor").orderBy("slot"))
    return slots.select("anchor", "slot", F.greatest(F.coalesce(following + 1, F.col("lowest")), F.col("lowest")).alias("low"), "high")


_ENTRY = "struct<down:bigint,id:bigint,row:bigint>"


def _suffixes(found: DataFrame, keep: int) -> DataFrame:
    """(anchor, suffixes): by ascending slot, the best `keep` entries of a slot and all below it."""
    entry = F.struct((-F.col("score")).alias("down"), "id", "row")
    lists = found.groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(entry)).alias("best"))  # `keep` entries at most
    slots = lists.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "best")), asc=False).alias("slots"))  # one per positive at most

    def merged(below, slot):
        under = F.coalesce(F.get(below, F.lit(0))["best"], F.array().cast(f"array<{_ENTRY}>"))
        return F.concat(F.array(F.struct(slot["slot"].alias("slot"), F.slice(F.concat(slot["best"], under), 1, keep).alias("best"))), below)

    start = F.array().cast(f"array<struct<slot:int,best:array<{_ENTRY}>>>")
    return slots.select("anchor", F.aggregate("slots", start, merged).alias("suffixes"))


def hard_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
                   anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `anchors`, a condition on vec_id and label, names the anchors. For each of
    them and each of its `positives` best rows, the first `negatives` rows of
    another label with low% <= score / positive score <= high%.
    """
    if not 0 <= low <= high:
        raise ValueError("the window lies between two percentages, the lower one first")
    given = as_float_arrays(pick(rows, vec_id=id_col, label=label_col, embedding=vector_col), "embedding")
    given = given.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), "embedding")
    stored = materialize(given.mapInArrow(_integers(scale), "row long, id long, label string, anchor boolean, vec binary"), "integers")
    chosen = stored.where("anchor").drop("anchor")
    number = chosen.count()
    if number > anchor_rows:
        chosen = materialize(placed(chosen, [], ["id", "row"]), "anchors")
    names = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    every = stored.select("row", "id", "label", "vec")
    out = None
    for first in range(0, max(number, 1), anchor_rows):
        some = chosen.where(F.col("pos").between(first, first + anchor_rows - 1)) if number > anchor_rows else chosen
        block = SharedTable(some.select("row", "label", "vec"))
        best = _first(every.mapInArrow(_positives(block, positives), _CANDIDATES), positives)
        windows = materialize(_windows(best, low, high), "windows")
        limits = SharedTable(_slot_limits(windows))
        found = _first(every.mapInArrow(_negatives(block, limits, positives, negatives), _CANDIDATES), negatives)
        best_of = F.get(F.filter("suffixes", lambda x: x["slot"] >= F.col("slot")), F.lit(0))["best"]
        answers = (windows.join(_suffixes(found, negatives), "anchor").withColumn("best", best_of)
                   .select("anchor", "positive_id", "positive_score", F.posexplode(F.filter("best", lambda x: -x["down"] >= F.col("low"))).alias("at", "one")))
        part = materialize(answers.select("anchor", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("negative_id"),
                                          "positive_score", (-F.col("one.down")).alias("negative_score")), "negatives")
        out = part if out is None else out.unionByName(part)
    return out.join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
