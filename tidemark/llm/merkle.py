"""Merkle manifest of a dataset, with a proof for every row.

Method: rows become leaves, leaves of a source a tree of arity 3, and the
sources' roots a tree of their own. A tree is cut into aligned subtrees of
`height` levels of links. Each subtree is one row of a table, its digests laid
out in van Emde Boas order: a tree is split at half its height, the top part
comes first, then the bottom parts from left to right, each laid out in the same
way. The address of a node follows from its depth and number alone; building a
subtree and finding siblings both go by those addresses. The roots of subtrees
are the leaves of the next round, until one root is left.

Proofs come down the same way: a subtree knows the path of its root, and adds to
it what lies inside itself. So a row meets one subtree, and work outside the
first round is 3^-height of the rows.

Hashes: H is the lowercase hex sha256 of its inputs laid end to end, digests as
hex text. A leaf is H of doc_id, source, lang, n_chars and text, each `-` if
null, else its UTF-8 byte count, `:` and the value.

Defined results: leaves ascend by doc_id, null first, equal ids by leaf, so
repeated rows have the same digests in any order; a null source is a source of
its own before all others; an empty table gives an empty result; other columns
are ignored. Texts are hashed where they are read and never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import grouped, materialize, pick, placed

ARITY = 3
HEIGHT = 8
WIDTH = 32  # bytes of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def tree_size(levels: int) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def addresses(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes `index` of a depth (0: the root) in the van Emde Boas order of a tree of `levels` levels."""
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        step = ARITY ** (depth - top)
        at += tree_size(top) + index // step * tree_size(levels - top)
        index, levels, depth = index % step, levels - top, depth - top
    return at


def levels_above(leaves: int) -> int:
    """Rounds of hashing from so many leaves to one root."""
    height = 0
    while ARITY ** height < leaves:
        height += 1
    return height


def build_subtree(leaves: np.ndarray, height: int) -> np.ndarray:
    """Digests, in van Emde Boas order, of the subtree over up to 3^height leaves; a short run, even of one, is hashed too."""
    nodes = np.zeros((tree_size(height + 1), WIDTH), np.uint8)
    nodes[addresses(height + 1, height, np.arange(len(leaves)))] = leaves
    count, run = len(leaves), ARITY * 2 * WIDTH
    for depth in range(height, 0, -1):
        text = nodes[addresses(height + 1, depth, np.arange(count))].tobytes().hex().encode()
        count = -(-count // ARITY)
        parents = b"".join(hashlib.sha256(text[i * run:(i + 1) * run]).digest() for i in range(count))
        nodes[addresses(height + 1, depth - 1, np.arange(count))] = np.frombuffer(parents, np.uint8).reshape(count, WIDTH)
    return nodes


def subtree_paths(nodes: np.ndarray, height: int, count: int, index: np.ndarray) -> list[bytes]:
    """Path of each leaf `index` to the subtree's root: per level its place, the run's width and the siblings' digests."""
    out = [[] for _ in index]
    for depth in range(height, 0, -1):
        first = index // ARITY * ARITY
        width, place = np.minimum(ARITY, count - first), index - first
        around = np.minimum(first[:, None] + np.arange(ARITY), count - 1)
        digests = nodes[addresses(height + 1, depth, around.ravel())].reshape(len(index), ARITY, WIDTH)
        for path, row, w, p in zip(out, digests, width.tolist(), place.tolist()):
            path.append(bytes((p, w)) + row[:p].tobytes() + row[p + 1:w].tobytes())
        index, count = index // ARITY, -(-count // ARITY)
    return [b"".join(path) for path in out]


def steps(path: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(place, width, siblings) of each level of a path."""
    at = 0
    while at < len(path):
        end = at + 2 + (path[at + 1] - 1) * WIDTH
        yield path[at], path[at + 1], path[at + 2:end]
        at = end


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that follows from a leaf and its siblings."""
    for place, _, siblings in steps(path):
        cut = place * WIDTH
        digest = hashlib.sha256((siblings[:cut].hex() + digest.hex() + siblings[cut:].hex()).encode()).digest()
    return digest


def _leaf(text: Column) -> Column:
    parts = []
    for name in FIELDS:
        value = text if name == "text" else F.col(name).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, WIDTH)


def _subtree_height(n: int, height: int) -> int:
    return min(height, levels_above(n))


def _built(height: int):
    """Leaves (grp, block, n, digest), sorted, to their subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, block, n), rows in grouped(batches, 3):
            nodes = build_subtree(_matrix(rows["digest"]), _subtree_height(n, height))
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp], pa.binary()), pa.array([block], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([nodes.tobytes()], pa.binary()), pa.array([nodes[0].tobytes()], pa.binary())],
                ["grp", "block", "n", "nodes", "root"])

    return run


def _subtrees(entries: DataFrame, height: int) -> list[DataFrame]:
    """Tables of subtrees (grp, block, n, nodes, root) from the leaves (grp, pos, n, digest) up; a group ends where n fits one subtree."""
    most = ARITY ** height
    longest = entries.agg(F.max("n")).first()[0] or 0
    layers, level = [], entries
    while True:
        cut = level.select("grp", F.floor(F.col("pos") / most).cast("long").alias("block"), "n", "digest", "pos")
        cut = cut.repartition("grp", "block").sortWithinPartitions("grp", "block", "n", "pos").drop("pos")
        layers.append(materialize(cut.mapInArrow(_built(height), "grp binary, block long, n long, nodes binary, root binary"), "subtrees"))
        if longest <= most:
            return layers
        longest = -(-longest // most)
        level = layers[-1].where(F.col("n") > most).select(
            "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / most).cast("long").alias("n"), F.col("root").alias("digest"))


def _roots(layers: list[DataFrame], height: int) -> DataFrame:
    """(grp, root) of all groups."""
    done = [layer.where(F.col("n") <= ARITY ** height).select("grp", "root") for layer in layers]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _inner_paths(height: int):
    """Subtrees with their root's path to the paths of all their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = ARITY ** height
        for batch in batches:
            for grp, block, n, nodes, path in zip(*(c.to_pylist() for c in batch.columns)):
                first, tall = block * most, _subtree_height(n, height)
                count = min(most, n - first)
                found = subtree_paths(np.frombuffer(nodes, np.uint8).reshape(-1, WIDTH), tall, count, np.arange(count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * count, pa.binary()), pa.array(np.arange(first, first + count)), pa.array([x + path for x in found], pa.binary())],
                    ["grp", "pos", "path"])

    return run


def _with_paths(layers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest subtrees with `path`, that of their root; `above` has (grp, path) of whole groups' roots."""
    found = None
    for number, layer in reversed(list(enumerate(layers))):
        most = F.col("n") <= ARITY ** height
        known = layer.where(most).join(above, "grp")
        if found is not None:
            known = known.unionByName(layer.where(~most).join(found.withColumnRenamed("pos", "block"), ["grp", "block"]))
        if number == 0:
            return known
        found = materialize(known.select("grp", "block", "n", "nodes", "path").mapInArrow(
            _inner_paths(height), "grp binary, pos long, path binary"), "paths")


_PROOFS = ("doc_id long, leaf string, subroot string, root string, siblings string, turns string, folded_root string, verified boolean")


def _proved(height: int):
    """Subtrees, each followed by its rows, to the rows' proofs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, current = ARITY ** height, None
        for batch in batches:
            rows = batch.num_rows
            heads = np.flatnonzero(pc.is_valid(batch.column(2)).to_numpy(zero_copy_only=False)).tolist()
            # what is before the first head belongs to the subtree of the batch before
            for head, end in zip([-1, *heads], [*heads, rows]):
                if head >= 0:
                    grp, block, nodes, n, path, subroot, root = (c[head].as_py() for c in batch.columns[:7])
                    first, tall = block * most, _subtree_height(n, height)
                    current = (np.frombuffer(nodes, np.uint8).reshape(-1, WIDTH), first, tall, min(most, n - first), path, subroot, root)
                if end == head + 1:
                    continue
                nodes, first, tall, count, above, subroot, root = current
                part = batch.slice(head + 1, end - head - 1)
                index = part.column(7).to_numpy() - first
                leaves, claims = part.column(8).to_pylist(), part.column(9).to_pylist()
                out = [[], [], [], []]
                for inside, claim in zip(subtree_paths(nodes, tall, count, index), claims):
                    path = inside + above
                    out[0].append("".join(siblings.hex() for _, _, siblings in steps(path)))
                    out[1].append(" ".join(f"{place}/{width}" for place, width, _ in steps(path)))
                    folded = fold(claim, path)
                    out[2].append(folded.hex())
                    out[3].append(folded == root)
                size = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [part.column(10), pa.array([x.hex() for x in leaves]), pa.array([subroot.hex()] * size), pa.array([root.hex()] * size),
                     *(pa.array(x, pa.string()) for x in out[:3]), pa.array(out[3], pa.bool_())],
                    ["doc_id", "leaf", "subroot", "root", "siblings", "turns", "folded_root", "verified"])

    return run


def manifest_proofs(docs: DataFrame, claimed: Column | None = None, height: int = HEIGHT, id_col: str = "doc_id",
                    source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, leaf, subroot, root, siblings, turns, folded_root, verified) of every row.

    `siblings` has the digests a holder of the row needs, level by level from
    the leaf to the root, left to right, as hex text laid end to end; `turns`
    the row's place in each run and the run's width. `claimed`, an expression
    over doc_id and text, is the text a holder shows (default: the text itself);
    `folded_root` is the root that follows from it and the siblings.
    """
    if not 1 <= height <= 10:
        raise ValueError("subtrees have 1 to 10 levels: a subtree is one row")
    rows = pick(docs, doc_id=id_col, source=source_col, lang=lang_col, n_chars=size_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    source, shown = F.col("source").cast("string"), F.col("text") if claimed is None else claimed
    leaves = rows.select(
        F.when(source.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), source.cast("binary"))).alias("grp"),
        "doc_id", _leaf(F.col("text")).alias("digest"),
        F.when(shown.eqNullSafe(F.col("text")), F.lit(None)).otherwise(_leaf(shown)).alias("claim"),
        F.monotonically_increasing_id().alias("row"))
    leaves = placed(materialize(leaves, "leaves"), ["grp"], ["doc_id", "digest", "row"])
    leaves = materialize(leaves.drop("row"), "ordered")
    layers = _subtrees(leaves.select("grp", "pos", "n", "digest"), height)

    subroots = materialize(_roots(layers, height), "subroots")
    one = F.lit(b"").alias("one")
    tops = materialize(placed(subroots.select(one, F.col("grp").alias("source_grp"), F.col("root").alias("digest")), ["one"], ["source_grp"]), "tops")
    upper = _subtrees(tops.select(F.col("one").alias("grp"), "pos", "n", "digest"), height)
    root = _roots(upper, height).select("grp", F.lit(b"").alias("path"), "root")
    paths = _with_paths(upper, root.select("grp", "path"), height).select("grp", "block", "n", "nodes", "path").mapInArrow(
        _inner_paths(height), "grp binary, pos long, path binary")
    above = (tops.join(paths.drop("grp"), "pos").join(root.select(F.col("grp").alias("one"), "root"), "one")
             .select(F.col("source_grp").alias("grp"), "path", F.col("digest").alias("subroot"), "root"))
    above = materialize(above, "above")

    heads = _with_paths(layers, above.select("grp", "path"), height).drop("root").join(above.drop("path"), "grp")
    none = lambda t: F.lit(None).cast(t)
    heads = heads.select("grp", "block", "nodes", "n", "path", "subroot", "root", none("long").alias("pos"), none("binary").alias("digest"),
                         none("binary").alias("claim"), none("long").alias("doc_id"))
    entries = leaves.select("grp", F.floor(F.col("pos") / ARITY ** height).cast("long").alias("block"), none("binary").alias("nodes"),
                            none("long").alias("n"), none("binary").alias("path"), none("binary").alias("subroot"), none("binary").alias("root"),
                            "pos", "digest", F.coalesce("claim", "digest").alias("claim"), "doc_id")
    # the subtree comes first, as its `pos` is null
    return (heads.unionByName(entries).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
            .mapInArrow(_proved(height), _PROOFS))

