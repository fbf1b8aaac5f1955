"""Near duplicates among embeddings by sorted projection passes.

Method: in every pass a vector gets 64 random hashes, the sides of random
hyperplanes it lies on, laid end to end. Vectors are ordered lexicographically
by them, and each one is compared with the `window` vectors after it; cosines in
double precision decide. Verified pairs of all passes are united into
components. Several passes share a job; a pass is range-partitioned, and the few
rows at both sides of a cut are compared in a second step, so windows do not end
at partitions.

The number of passes follows from the rows. Two vectors at the cosine limit
share one hash with probability p = 1 - angle / pi, and are certain to meet where
they share the first log2(rows / window) ones; there are as many passes as a
pair needs to meet with probability `recall`. That grows as rows^0.22 for a
cosine of 0.9.

Windows are bounded, links are not: inside a component links are counted by an
exact way, whether or not a pass met them. Small components are compared whole,
by matrix products. In larger ones, angles to the component's mean bound all
others: rows whose two angles add up to the limit's angle or less are linked
without being compared, by counts of angles; what is left over, pairs with a row
far from the mean, is compared block by block. So a tight group of copies,
however large, costs as much as its rows.

Defined results: rows with a null, empty or zero vector, or one with a null or
non-finite component, link with nothing; vectors of different length do not link;
equal vectors are one node and each other's links; ids may be null or repeated
(a row is a vector of its own; a component without any id has a null id, and
its rows are kept); an empty table gives an empty result; other columns,
labels too, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, join_groups, materialize, per_process, pick, placed
from tidemark.llm.graph import components
from tidemark.llm.vectors import as_float_arrays, by_length, packed, unpacked

COSINE = 0.9
WINDOW = 128
RECALL = 0.999
HASHES = 64
PASSES_AT_ONCE = 8
CHUNK_ROWS = 1 << 15
BLOCK_ROWS = 4096
SEED = 11
ANGLES = 512  # steps of the limit's angle
_SAFE = 1e-6  # angles that bound others are taken as larger by this much


def passes_needed(rows: int, cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the limit has met with probability `recall`."""
    same = 1 - math.acos(cosine) / math.pi
    met = same ** max(0.0, math.log2(max(rows, 1) / window))
    return 1 if met >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _units(matrix: np.ndarray) -> np.ndarray:
    wide = matrix.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, null where a row links with nothing; both zeros are one value."""

    def parts(column):
        for rows, matrix in by_length(column):
            good = np.isfinite(matrix).all(axis=1) & (matrix != 0).any(axis=1)
            yield rows[good], matrix[good] + matrix.dtype.type(0)

    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], packed(batch.num_rows, parts(batch.column(2)))], ["row", "vec_id", "vec"])


def _keyed(kind: str, first: int, last: int, seed: int):
    """(node, vec) to one row per pass with the pass's hashes as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                part = batch.take(pa.array(rows))
                units = _units(unpacked(part.column(1), kind))
                for number in range(first, last):
                    planes = per_process(f"planes {number - first}", (seed, number, units.shape[1]), lambda: np.random.default_rng(
                        [seed, number]).standard_normal((units.shape[1], HASHES)))
                    bits = np.packbits(units @ planes > 0, axis=1)  # the first hash is the highest bit
                    # signed order of the number is the order of its bits
                    key = (bits.view(">u8").ravel() ^ np.uint64(1 << 63)).astype(np.uint64).view(np.int64)
                    n = len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, number)), pa.array(np.full(n, size)), pa.array(key), part.column(0), part.column(1)],
                        ["part", "size", "key", "node", "vec"])

    return run


def _forest(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least row each row is connected with."""
    root = np.arange(count)
    while len(left):
        least = np.minimum(root[left], root[right])
        np.minimum.at(root, left, least)
        np.minimum.at(root, right, least)
        np.minimum.at(root, root[left], least)
        root = root[root]
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _band(units: np.ndarray, window: int, cosine: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at most `window` apart with at least the cosine."""
    left, right = [], []
    for first in range(0, len(units), step):
        some = units[first:first + step]
        near = some @ units[first:first + step + window].T >= cosine
        i, j = np.nonzero(near)
        inside = (j > i) & (j - i <= window)
        left.append(i[inside] + first)
        right.append(j[inside] + first)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


_SEEN = ["a", "b", "place", "part", "size", "node", "vec"]
_SEEN_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
_SEEN_SCHEMA = "a long, b long, place long, part long, size long, node long, vec binary"


def _seen_rows(count: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in zip(_SEEN, _SEEN_KINDS)], _SEEN)


def _compared(kind: str, window: int, cosine: float, ends: bool):
    """Sorted rows (part, size, key, node, vec) to links (a, b), a forest of those each batch finds.

    With `ends` also the first and last `window` rows, with their place in the
    partition, and the partition's rows (place alone).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, carry, last = 0, None, []
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            part, size, node = (batch.column(i).to_numpy() for i in (0, 1, 3))
            new = np.flatnonzero((part[1:] != part[:-1]) | (size[1:] != size[:-1])) + 1
            for first, end in zip([0, *new.tolist()], [*new.tolist(), rows]):
                units, nodes, key = _units(unpacked(batch.column(4).slice(first, end - first), kind)), node[first:end], (part[first], size[first])
                if carry is not None and carry[0] == key:
                    units, nodes = np.concatenate([carry[1], units]), np.concatenate([carry[2], nodes])
                root = _forest(len(units), *_band(units, window, cosine))
                linked = np.flatnonzero(root != np.arange(len(root)))
                if len(linked):
                    yield _seen_rows(len(linked), a=nodes[linked], b=nodes[root[linked]])
                carry = key, units[-window:].copy(), nodes[-window:].copy()
            if ends:
                places = np.arange(total, total + rows)
                early = batch.slice(0, max(0, min(rows, window - total)))
                if early.num_rows:
                    yield _seen_rows(early.num_rows, place=places[:early.num_rows], part=early.column(0), size=early.column(1),
                                     node=early.column(3), vec=early.column(4))
                last = [*last, (places, batch)]
                while len(last) > 1 and sum(len(p) for p, _ in last[1:]) >= window:
                    last.pop(0)
            total += rows
        if ends and total:
            for places, batch in last:
                wanted = np.flatnonzero((places >= total - window) & (places >= window))
                if len(wanted):
                    late = batch.take(pa.array(wanted))
                    yield _seen_rows(len(wanted), place=places[wanted], part=late.column(0), size=late.column(1), node=late.column(3), vec=late.column(4))
            yield _seen_rows(1, place=[total])

    return run


def _at_seams(offsets: dict[int, int], window: int):
    """Rows near the ends of partitions to the seams they lie at: (seam, pos, part, size, node, vec)."""
    seams = np.array(sorted({at for at in offsets.values() if at > 0}), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(seams):
                continue
            pos = batch.column(1).to_numpy() + np.array([offsets[c] for c in batch.column(0).to_pylist()], np.int64)
            # seams with pos - window < seam <= pos + window
            low, high = np.searchsorted(seams, pos - window, "right"), np.searchsorted(seams, pos + window, "right")
            rows = np.repeat(np.arange(len(pos)), high - low)
            at = np.concatenate([seams[a:b] for a, b in zip(low.tolist(), high.tolist())]) if len(rows) else np.empty(0, np.int64)
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(pos[rows]), *part.columns[2:]], ["seam", "pos", "part", "size", "node", "vec"])

    return run


def _pass_links(nodes: DataFrame, kind: str, first: int, last: int, total: int, cosine: float, window: int, seed: int) -> DataFrame:
    """(a, b) links that the passes first .. last - 1 verify."""
    order = ["part", "size", "key", "node"]
    keyed = nodes.select("node", "vec").mapInArrow(_keyed(kind, first, last, seed), "part long, size long, key long, node long, vec binary")
    chunks = max(1, -(-total * (last - first) // CHUNK_ROWS))
    ranged = keyed.repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    seen = materialize(ranged.mapInArrow(_compared(kind, window, cosine, True), _SEEN_SCHEMA).withColumn("chunk", F.spark_partition_id()), "pass")
    links = seen.where("a IS NOT NULL").select("a", "b")
    sizes = {r.chunk: r.place for r in seen.where("a IS NULL AND node IS NULL").select("chunk", "place").collect()}  # a number per partition
    offsets, at = {}, 0
    for chunk in sorted(sizes):
        offsets[chunk], at = at, at + sizes[chunk]
    if len(offsets) < 2:
        return links
    near = seen.where("node IS NOT NULL").select("chunk", "place", "part", "size", "node", "vec").mapInArrow(
        _at_seams(offsets, window), "seam long, pos long, part long, size long, node long, vec binary")
    # a seam's rows follow each other in the order of the passes; seam and pass together are a part
    stitched = (near.withColumn("part", F.col("seam") * (last - first) + F.col("part") - first).repartition("seam")
                .sortWithinPartitions("seam", "pos").select("part", "size", F.col("pos").alias("key"), "node", "vec")
                .mapInArrow(_compared(kind, window, cosine, False), _SEEN_SCHEMA).select("a", "b"))
    return links.unionByName(materialize(stitched, "seams"))


def _mean_parts(kind: str):
    """(root, vec) to sums of unit vectors, one per root and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = batch.column(0).to_numpy()
            order = np.argsort(roots, kind="stable")
            cuts = np.flatnonzero(np.diff(roots[order])) + 1
            groups = [g for g in np.split(order, cuts) if len(g)]
            sums = [_units(unpacked(batch.column(1).take(pa.array(g)), kind)).sum(axis=0).tobytes() for g in groups]
            yield pa.RecordBatch.from_arrays([pa.array([int(roots[g[0]]) for g in groups], pa.int64()), pa.array(sums, pa.binary())], ["root", "mean"])

    return run


def _means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, total = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["root", "mean"])

    for batch in batches:
        for root, mean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if root != current:
                if total is not None:
                    yield out()
                current, total = root, np.zeros(len(mean) // 8)
            total += np.frombuffer(mean, np.float64)
    if total is not None:
        yield out()


def _step(cosine: float) -> float:
    return (math.acos(cosine) - _SAFE) / ANGLES


def _angles(kind: str, cosine: float):
    """(root, node, members, vec, mean) with `bin`, the step of the angle to the mean, instead of the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, vecs = batch.column(4).to_pylist(), batch.column(3).to_pylist()
            bins = np.empty(len(vecs), np.int64)
            sizes = np.fromiter(map(len, vecs), np.int64, len(vecs))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                mean = np.frombuffer(b"".join(means[i] for i in at), np.float64).reshape(len(at), -1)
                units = _units(np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), -1))
                length = np.sqrt(np.einsum("ij,ij->i", mean, mean))
                near = np.einsum("ij,ij->i", units, mean) / np.maximum(length, 1e-300)
                angle = np.where(length > 1e-9, np.arccos(np.clip(near, -1, 1)), math.pi)
                bins[at] = np.floor((angle + _SAFE) / _step(cosine))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(bins)], ["root", "node", "members", "vec", "bin"])

    return run


def _certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, bin, members), sorted, to how many members every bin is certain to link with: those whose bins add up to ANGLES - 2 at most."""
    for (root,), rows in grouped(batches, 1):
        bins, sums = rows["bin"].to_numpy(), np.concatenate([[0], np.cumsum(rows["members"].to_numpy())])
        sure = sums[np.searchsorted(bins, ANGLES - 2 - bins, "right")]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), root)), pa.array(bins), pa.array(sure)], ["root", "bin", "sure"])


def _counted(kind: str, cosine: float, step: int = 512):
    """Pairs of blocks (root, p, q, side, node, members, bin, vec), sorted, to links counted: (node, links).

    Rows of side 0 are compared with those of side 1, or with each other where
    p = q; pairs whose bins make them certain have been counted before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, p, q), rows in grouped(batches, 3):
            side, node, members, bins = (rows[c].to_numpy() for c in ("side", "node", "members", "bin"))
            units = _units(unpacked(rows["vec"], kind))
            a = np.flatnonzero(side == 0)
            b = a if p == q else np.flatnonzero(side == 1)
            links = np.zeros(len(node), np.int64)
            for first in range(0, len(a), step):
                some = a[first:first + step]
                linked = (units[some] @ units[b].T >= cosine) & (bins[some][:, None] + bins[b][None, :] > ANGLES - 2)
                if p == q:
                    linked &= some[:, None] != b[None, :]
                links[some] += linked @ members[b]
                if p != q:
                    links[b] += members[some] @ linked
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])

    return run


def link_counts(members: DataFrame, kind: str, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, links) of rows (root, node, members, vec): members of all other nodes of the component within the cosine."""
    sizes = materialize(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    large = sizes.where(F.col("n") > block_rows).select("root")
    none = F.lit(0).cast("long")
    # a bin as large as no angle has: nothing is certain before it is compared
    pairs = members.join(large, "root", "left_anti").select(
        "root", none.alias("p"), none.alias("q"), F.lit(0).alias("side"), "node", "members", F.lit(1 << 20).cast("long").alias("bin"), "vec")
    sure = None
    if not large.isEmpty():
        rows = materialize(members.join(large, "root", "left_semi").select("root", "node", "members", "vec"), "large")
        means = (rows.select("root", "vec").mapInArrow(_mean_parts(kind), "root long, mean binary").repartition("root")
                 .sortWithinPartitions("root").mapInArrow(_means, "root long, mean binary"))
        rows = rows.join(materialize(means, "means"), "root").select("root", "node", "members", "vec", "mean").mapInArrow(
            _angles(kind, cosine), "root long, node long, members long, vec binary, bin long")
        rows = placed(materialize(rows, "angles"), ["root"], ["bin", "node"]).withColumn("block", F.floor(F.col("pos") / block_rows).cast("long"))
        rows = materialize(rows.drop("pos", "n"), "blocks")
        counts = rows.groupBy("root", "bin").agg(F.sum("members").alias("members"))
        known = (counts.repartition("root").sortWithinPartitions("root", "bin").select("root", "bin", "members")
                 .mapInArrow(_certain, "root long, bin long, sure long"))
        own = F.when(F.col("bin") * 2 <= ANGLES - 2, F.col("members")).otherwise(0)
        sure = rows.select("root", "bin", "node", "members").join(known, ["root", "bin"]).select("node", (F.col("sure") - own).alias("links"))
        # blocks ascend by angle, so the larger one of a pair decides whether anything is left to compare
        blocks = materialize(rows.groupBy("root", "block").agg(F.max("bin").alias("top")), "block_angles")
        outer = blocks.where(F.col("top") * 2 > ANGLES - 2).select("root", F.col("block").alias("p"), F.col("top").alias("p_top"))
        meet = outer.join(blocks.select("root", F.col("block").alias("q"), F.col("top").alias("q_top")), "root").where(
            "q <= p AND p_top + q_top > " + str(ANGLES - 2)).select("root", "p", "q")
        meet = materialize(meet, "meetings")
        more = ["root", "p", "q", F.lit(0).alias("side"), "node", "members", "bin", "vec"]
        near = rows.join(meet.withColumn("block", F.col("p")), ["root", "block"]).select(*more)
        far = rows.join(meet.where("q < p").withColumn("block", F.col("q")), ["root", "block"]).select(*more[:3], F.lit(1).alias("side"), *more[4:])
        pairs = pairs.unionByName(near).unionByName(far)
    keys = ["root", "p", "q"]
    counted = (pairs.repartition(*keys).sortWithinPartitions(*keys, "side", "node").mapInArrow(_counted(kind, cosine), "node long, links long"))
    if sure is not None:
        counted = counted.unionByName(sure)
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, window: int = WINDOW,
                 recall: float = RECALL, passes: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    `n_links` counts the other rows of the component within the cosine,
    `component_id` is the least id reachable, `kept` whether that is the row's
    own. `passes` overrides the number that `recall` asks for.
    """
    if not 0 < cosine < 1:
        raise ValueError("the cosine limit lies between 0 and 1")
    given = as_float_arrays(pick(rows, vec_id=id_col, embedding=vector_col), "embedding")
    kind = "<f4" if dict(given.dtypes)["embedding"] == "array<float>" else "<f8"
    usable = given.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
        _usable, "row long, vec_id long, vec binary")
    stored = materialize(usable.withColumn("digest", F.unhex(F.sha2("vec", 256))), "vectors")
    # equal vectors are one node, named by its first row
    nodes = materialize(stored.where("vec IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("node"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("members"), F.first("vec").alias("vec")), "nodes")
    total = nodes.count()
    count = passes_needed(total, cosine, window, recall) if passes is None else passes
    links = None
    for first in range(0, count, PASSES_AT_ONCE):
        found = _pass_links(nodes, kind, first, min(first + PASSES_AT_ONCE, count), total, cosine, window, seed)
        links = found if links is None else links.unionByName(found)
    roots = components(links)
    named = materialize(nodes.join(roots, "node", "left").select(
        "digest", "node", "first_id", "members", F.coalesce("root", "node").alias("root")), "named")
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("component_id"))
    sizes = materialize(sizes, "sizes")
    inside = materialize(nodes.select("node", "vec").join(join_groups(
        named.select("root", "node", "members"), sizes.where("n > 1").select("root"), ["root"], sizes, total), "node")
        .select("root", "node", "members", "vec"), "members")
    counts = materialize(link_counts(inside, kind, cosine, block_rows), "counts")
    entries = join_groups(named, sizes.select("root", "component_id"), ["root"], sizes, total).join(counts, "node", "left").select(
        "digest", "component_id", "members", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    entries = materialize(entries, "entries")
    joined = join_groups(stored.where("vec IS NOT NULL").select("digest", "vec_id"), entries.drop("members"), ["digest"],
                         entries.select("digest", F.col("members").alias("n")), stored.count())
    alone = stored.where("vec IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = joined.select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
