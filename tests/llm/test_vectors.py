"""Embedding near-dedup and hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import embedding_dedup, hard_negatives
from tidemark.llm.hard_negatives import Best

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, schema=SCHEMA):
    plain = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], None if y is None else int(y))
             for i, v, y in rows]
    return spark.createDataFrame(plain, schema).selectExpr("*", "'k' AS key", "1 AS node", "2 AS row", "3 AS part", "'c' AS root", "4 AS `Label `")


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain_links(rows, cosine):
    """(vec_id, n_links, component_id, kept) over all pairs of rows."""
    n = len(rows)
    near = np.zeros((n, n), bool)
    good = [i for i in range(n) if usable(rows[i][1])]
    for size in {len(rows[i][1]) for i in good}:
        at = [i for i in good if len(rows[i][1]) == size]
        x = np.array([rows[i][1] for i in at], np.float32).astype(np.float64)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near[np.ix_(at, at)] = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(n)
    while True:
        least = np.where(near, root[None, :], n).min(axis=1, initial=n)
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], int(near[i].sum()), component, rows[i][0] == component))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    """Scattered vectors, pairs just above and below the limit, a tight group, a loose one, chains and equal vectors."""
    pick = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x)

    def at_cosine(x, cosine):
        y = pick.standard_normal(len(x))
        y = unit(y - (y @ x) * x)
        return cosine * x + math.sqrt(1 - cosine ** 2) * y

    rows = [unit(pick.standard_normal(32)) for _ in range(300)]
    rows += [at_cosine(rows[i], c) for i, c in zip(range(0, 120), np.linspace(0.88, 0.93, 120))]
    centre = unit(pick.standard_normal(32))
    rows += [at_cosine(centre, 0.99) for _ in range(200)]
    centre = unit(pick.standard_normal(32))
    rows += [at_cosine(centre, pick.uniform(0.9, 1.0)) for _ in range(150)]
    x = unit(pick.standard_normal(32))
    for _ in range(40):
        x = at_cosine(x, 0.92)
        rows.append(x)
    rows += [rows[310]] * 30 + [rows[5] * 7]
    order = pick.permutation(len(rows))
    return [(i, rows[j].astype(np.float32).tolist(), None) for i, j in enumerate(order)]


@pytest.fixture(scope="module")
def odd():
    a, b = [1.0, 0.0, 0.5], [1.0, 0.01, 0.5]
    return [(1, a, 1), (2, b, 2), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, -0.0], 1), (6, [1.0, None, 0.5], 1), (7, [1.0, math.nan, 0.5], 1),
            (8, [1.0, math.inf, 0.5], 3), (None, a, None), (None, [0.0, 5.0, 0.0], 1), (9, [0.0, 5.0, 0.1], 2), (9, [0.0, 5.0, 0.1], 2), (9, [-3.0, 0.0, 0.0], 2),
            (10, [1.0, 0.5], 1), (11, [1.0, 0.51], 1), (12, [-0.0, 5.0, 0.0], 1), (None, [0.0, 0.0, -2.0], None), (13, [3e38, 3e38, 3e38], 2), (14, [1e-38, 1e-38, 1e-38], 2)]


@pytest.mark.parametrize("block_rows, chunk_rows", [(4096, 1 << 15), (64, 500), (7, 100)])
def test_links_of_all_pairs(spark, monkeypatch, vectors, block_rows, chunk_rows):
    """Every link within a component is counted, in however many blocks; parts of passes join at their seams."""
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk_rows)
    found = embedding_dedup.near_vectors(frame(spark, vectors), window=16, block_rows=block_rows)
    assert got(found) == plain_links(vectors, 0.9)


def test_windows_need_enough_passes(spark, vectors):
    assert embedding_dedup.passes_needed(100) == 1 and embedding_dedup.passes_needed(50_000) < embedding_dedup.passes_needed(10 ** 7) < 100
    want, few = plain_links(vectors, 0.9), got(embedding_dedup.near_vectors(frame(spark, vectors), window=2, passes=1))
    assert few != want and sum(r[1] for r in few) < sum(r[1] for r in want)  # and no link that is none
    assert all(a[1] <= b[1] for a, b in zip(few, want))


def test_odd_vectors(spark, odd):
    rows = frame(spark, odd)
    assert got(embedding_dedup.near_vectors(rows)) == plain_links(odd, 0.9)
    wide = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert got(embedding_dedup.near_vectors(wide)) == plain_links(odd, 0.9)
    assert embedding_dedup.near_vectors(rows.limit(0)).collect() == []


def test_a_hot_group_is_not_compared(spark, monkeypatch):
    """A tight group over many blocks: all its links are counted by angles, no two rows meet."""
    pick = np.random.default_rng(5)
    centre = pick.standard_normal(64)
    rows = [(i, (centre + 0.1 * pick.standard_normal(64)).astype(np.float32).tolist(), None) for i in range(1500)]
    monkeypatch.setattr(embedding_dedup, "_counted", lambda kind, cosine: lambda batches: (b.select([3, 4]) and 1 / 0 for b in batches if b.num_rows))
    found = embedding_dedup.near_vectors(frame(spark, rows), block_rows=200).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(1499, 0)}


# ---- hard negatives -------------------------------------------------------------------------------

def plain_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    part = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    part = [r for r in part if all(abs(x) < 1 << 26 for x in r[1])]
    out = []
    for k, (i, v, y) in enumerate(part):
        if not anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, m, z) for m, (j, w, z) in enumerate(part) if m != k and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1], s[2]))
        for score, j, _, _ in [s for s in scored if s[3] == y][:positives]:
            fits = [s for s in scored if s[3] != y and low * score <= 100 * s[0] <= high * score][:negatives]
            out += [(i, j, rank + 1, s[1], score, s[0]) for rank, s in enumerate(fits)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled():
    pick = np.random.default_rng(9)
    centres = pick.standard_normal((4, 12)) + 0.6
    rows = [(i, (0.1 * (centres[i % 4] + 0.7 * pick.standard_normal(12))).tolist(), [i % 4, None][i % 29 == 7]) for i in range(400)]
    # ties: equal vectors under different ids, repeated rows, and an id held by two rows
    rows += [(1000 + i, rows[8][1], 0) for i in range(6)] + [(2000 + i, rows[9][1], 1) for i in range(14)] + [rows[20], rows[20], (3, rows[40][1], 2)]
    return rows


@pytest.mark.parametrize("limits", [{}, {"positives": 3, "negatives": 4, "low": 0, "high": 100}, {"positives": 8, "low": 85, "high": 85, "anchor_rows": 7}])
def test_hard_negatives(spark, labelled, limits):
    df = frame(spark, labelled).repartition(5)
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, **limits)
    plain = {k: v for k, v in limits.items() if k != "anchor_rows"}
    assert sorted(map(tuple, found.collect())) == plain_negatives(labelled, lambda i: i % 20 == 0, **plain)


def test_hard_negatives_of_odd_rows(spark, odd, labelled):
    every = lambda rows: sorted(map(tuple, hard_negatives.hard_negatives(rows, F.lit(True), low=0, high=100).collect()))
    assert every(frame(spark, odd)) == plain_negatives(odd, lambda i: True, low=0, high=100)
    assert every(frame(spark, odd).limit(0)) == []
    none = hard_negatives.hard_negatives(frame(spark, labelled), F.lit(False))
    assert none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and none.collect() == []


def test_large_components_stay_exact():
    left = np.array([[(1 << 26) - 1, -(1 << 26) + 1, 3]], np.int32)
    assert hard_negatives._products(left, left)[0, 0] == 2 * ((1 << 26) - 1) ** 2 + 9


def test_best_entries():
    best = Best(2, 2, 2)
    best.add(np.array([0, 0, 1, 0]), 1, np.array([5, 7, 1, 7]), np.array([1, 3, 9, 2]), np.array([0, 0, 0, 0]))
    best.add(np.array([0]), 1, np.array([7]), np.array([2]), np.array([-1]))
    assert [tuple(map(int, e)) for e in zip(*best.entries())] == [(0, 1, 7, 2, -1), (0, 1, 7, 2, 0), (1, 1, 1, 9, 0)]
    assert best.least(1)[0] == 7
