"""Merkle manifest against plain trees."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def plain_tree(leaves):
    """Root, and the siblings of each leaf with its place, level by level."""
    paths, level, where = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i:i + 3] for i in range(0, len(level), 3)]
        for path, at in zip(paths, where):
            path.append((at % 3, runs[at // 3]))
        where = [at // 3 for at in where]
        level = [h(*run) for run in runs]
    return level[0], paths


def plain_proofs(rows, shown):
    sources = sorted({r.source for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in sources:
        mine = sorted(((r.doc_id is not None, r.doc_id or 0, plain_leaf(r, r.text), i) for i, r in enumerate(rows) if r.source == source))
        trees[source] = (mine, *plain_tree([m[2] for m in mine]))
    root, tops = plain_tree([trees[s][1] for s in sources])
    out = []
    for source, top in zip(sources, tops):
        mine, subroot, paths = trees[source]
        for (_, _, leaf, i), path in zip(mine, paths):
            digest, siblings = plain_leaf(rows[i], shown(rows[i])), ""
            for at, run in path + top:
                siblings += "".join(run[:at] + run[at + 1:])
                digest = h(*run[:at], digest, *run[at + 1:])
            out.append((rows[i].doc_id, leaf, subroot, root, siblings, " ".join(f"{at}/{len(run)}" for at, run in path + top), digest, digest == root))
    return sorted(out, key=str)


def without_feeds(r):
    return r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and r.doc_id % 2 == 0 else r.text


def claimed():
    return F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("height", [1, 2, 8])
def test_proofs(messy, varied, spark, height):
    more = varied.selectExpr("doc_id", "if(doc_id % 3 = 0, replace(text, ' ', '\n'), text) AS text", "'en' AS lang",
                             "case when doc_id < 130 then 'hot' when doc_id % 11 = 0 then null else source end AS source", "length(text) AS n_chars")
    for docs in (messy, more, messy.limit(1)) if height == 8 else (more,):
        found = merkle.manifest_proofs(docs, claimed(), height=height).collect()
        assert sorted(map(tuple, found), key=str) == plain_proofs(docs.select("doc_id", "source", "lang", "n_chars", "text").collect(), without_feeds)
    if height < 8:
        return
    assert any(not r.verified for r in merkle.manifest_proofs(more, claimed(), height=height).collect())
    assert all(r.verified for r in merkle.manifest_proofs(more, height=height).collect())


def test_no_rows(empty):
    assert merkle.manifest_proofs(empty).collect() == []


@pytest.mark.parametrize("levels", range(1, 9))
def test_addresses_are_a_split_at_half_height(levels):
    every = [merkle.addresses(levels, depth, np.arange(3 ** depth)) for depth in range(levels)]
    assert sorted(np.concatenate(every).tolist()) == list(range(merkle.tree_size(levels)))
    if levels > 1:
        top = levels // 2
        assert max(a.max() for a in every[:top]) == merkle.tree_size(top) - 1  # the top part comes first
        size = merkle.tree_size(levels - top)
        for number in range(3 ** top):  # then each lower part, by itself in the same order
            for depth in range(top, levels):
                inner = every[depth][number * 3 ** (depth - top):(number + 1) * 3 ** (depth - top)] - merkle.tree_size(top) - number * size
                assert inner.tolist() == merkle.addresses(levels - top, depth - top, np.arange(3 ** (depth - top))).tolist()


def test_a_wrong_sibling_is_noticed():
    leaves = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest() for i in range(20)), np.uint8).reshape(-1, 32)
    nodes = merkle.build_subtree(leaves, 3)
    paths = merkle.subtree_paths(nodes, 3, 20, np.arange(20))
    assert all(merkle.fold(leaf.tobytes(), path) == nodes[0].tobytes() for leaf, path in zip(leaves, paths))
    assert merkle.fold(leaves[4].tobytes(), paths[5]) != nodes[0].tobytes()
    assert merkle.fold(leaves[19].tobytes(), paths[19]) == nodes[0].tobytes() and len(list(merkle.steps(paths[19]))) == 3
