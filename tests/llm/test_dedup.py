"""Exact and near duplicates against plain versions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, exact_dedup, graph, simhash


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def plain_exact(rows):
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(bare(r.text), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0, i))
    out = []
    for i, r in enumerate(rows):
        group = groups[bare(r.text)]
        best = min(group)
        out.append((r.doc_id, None if best[1] else best[2], len(group), hashlib.sha256(bare(r.text).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("runs", [1, 7, 16])
def test_exact(messy, varied, runs):
    for docs in (messy, varied.repartition(5)):
        got = exact_dedup.exact_duplicates(docs, runs=runs).collect()
        rows = docs.select("doc_id", "text").collect()
        assert sorted(map(str, ((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got))) == sorted(map(str, plain_exact(rows)))
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_runs_meet_in_binomial_rounds(varied):
    """One exchange per round after the first fold, and sorted streams: no round sorts again to fold."""
    plan = exact_dedup._merge_runs(exact_dedup.pick(varied, doc_id="doc_id", text="text").selectExpr(
        "doc_id", "doc_id as row", "unhex(sha2(text, 256)) as digest", "xxhash64(text) as check", "length(text) as length", "length(text) as points"), 8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(run") == 4 and text.count("REPARTITION_BY_NUM") == 3
    assert text.count("Sort [run") == 2 + 3 and "Python" not in text and "Arrow" not in text


def test_exact_hot_and_cold_groups(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE 't' || (id % 500) END AS text")
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", 10)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(plain_exact(docs.collect()))


def test_exact_drop(messy, varied):
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns
    rows = kept.collect()
    assert len(rows) == len({bare(r.text) for r in messy.select("text").collect()})
    assert sorted(r.doc_id for r in rows if r.doc_id == 5) == [5]  # of two equal rows with the longest text one stays
    assert exact_dedup.drop_exact_duplicates(varied).count() == len({bare(r.text) for r in varied.collect()})


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty).collect() == []


def plain_fingerprint(text, shingle=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    pieces = [b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    prints, seen, root = list(prints), {}, {}
    for start in prints:
        if start in root:
            continue
        root[start], stack = start, [start]
        while stack:
            a = stack.pop()
            for b in prints:
                if b not in root and bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
                    root[b] = start
                    stack.append(b)
    return root


def test_fingerprints(messy, varied):
    for docs in (messy, varied):
        want = sorted(((r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
        got = sorted(((r.doc_id, r.print % (1 << 64)) for r in simhash.fingerprints(docs).collect()), key=str)
        assert got == want


@pytest.mark.parametrize("partitions", [None, 2, 3, 4, 5])
def test_links_of_clustered_prints(spark, partitions):
    """Chains, a dense ball and scattered prints: the components are those of all pairs."""
    pick = random.Random(3)
    prints = {pick.getrandbits(64) for _ in range(150)}
    centre = pick.getrandbits(64)
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in pick.sample(range(20), pick.randint(0, 6))))
    chain = pick.getrandbits(64)
    for _ in range(30):
        chain ^= sum(1 << b for b in pick.sample(range(64), 4))
        prints.add(chain)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "print long").repartition(4)
    got = {r.node: r.root for r in simhash.near_links(nodes, 4, partitions).collect()}
    want = plain_components(signed, 4)

    def groups(root):
        found = {}
        for p in signed:
            found.setdefault(root.get(p, p), set()).add(p)
        return sorted(map(sorted, found.values()))

    assert groups(got) == groups(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def noted(monkeypatch, module):
    """The plan of each step that the module stores, by name."""
    plans, store = {}, module.materialize

    def noting(df, label):
        plans.setdefault(label, []).append(plan(df))
        return store(df, label)

    monkeypatch.setattr(module, "materialize", noting)
    return plans


def test_many_probes_are_not_broadcast(spark, monkeypatch):
    """The planner takes prints with their values and probes for as small as the prints; few go as it likes."""
    plans = noted(monkeypatch, simhash)
    prints = np.random.default_rng(2).integers(-2**63, 2**63 - 1, 1000)
    prints[1::100] = prints[::100] ^ 0b1011
    nodes = spark.createDataFrame(pa.table({"print": np.unique(prints)}))
    pairs = np.sort(np.stack([prints[::100], prints[1::100]]), axis=0)
    for most in (200_000, 2000):
        monkeypatch.setattr(common, "MOST_BROADCAST", most, raising=False)
        plans.clear()
        found = {(r.node, r.root) for r in simhash.near_links(nodes, 4, 4).collect()}
        assert found == {(high, low) for low, high in pairs.T.tolist()}
        assert ("Broadcast" in "".join(plans["hub_links"] + plans["bridges"])) == (most > 2000)


def test_many_components_are_not_broadcast_to_prints(varied, monkeypatch):
    monkeypatch.setattr(common, "MOST_BROADCAST", 10, raising=False)
    kept = simhash.drop_near_duplicates(varied, partitions=4)
    assert "SortMergeJoin" in plan(kept)
    prints = {plain_fingerprint(r.text) for r in varied.collect()}
    assert kept.count() == len(set(plain_components(prints, 4).values()))


def test_many_links_are_not_broadcast(spark, monkeypatch):
    plans = noted(monkeypatch, graph)
    links = lambda n: spark.range(n).selectExpr("id * 2 as a", "id * 2 + 1 as b")
    few, many = (graph.components(links(n)) for n in (100, 120_000))
    assert (many.count(), many.where("root <> node - 1").count(), few.count()) == (120_000, 0, 100)
    joins = [p for p in plans["links"] if "Join" in p]
    assert "Broadcast" in joins[0] and "Broadcast" not in joins[-1]


def test_many_rows_of_small_groups_are_merged(spark):
    def joined(n):
        rows = spark.range(n).selectExpr("id % (id div 2 + 1) as k", "id as r")
        entries = rows.groupBy("k").agg(F.max("r").alias("last"))
        return common.join_groups(rows, entries, ["k"], rows.groupBy("k").agg(F.count("*").alias("n")), n)

    assert "SortMergeJoin" not in plan(joined(1000)) and "SortMergeJoin" in plan(joined(300_000))
    assert joined(300_000).agg(F.count("*"), F.count_if(F.col("last") < F.col("r"))).first() == (300_000, 0)


def test_allocation_covers_the_distance():
    pick = np.random.default_rng(1)
    for parts in (2, 3, 4, 5, 7):
        costs = [np.sort(pick.uniform(0, 9, 5)).tolist() for _ in range(parts)]
        cost, chosen = simhash.allocate(costs, 4)
        # Whatever way 4 differing bits fall, one partition holds at most its threshold.
        assert sum(t + 1 for t in chosen) == 5 and min(chosen) >= -1
        every = [c for c in itertools.product(range(-1, 5), repeat=parts) if sum(t + 1 for t in c) == 5]
        assert cost == pytest.approx(min(sum(own[t] for own, t in zip(costs, c) if t >= 0) for c in every))


def test_candidates_do_not_follow_the_rows():
    """Probes and candidates of a fingerprint stay near constant from 1e5 to 1e9 rows; four fixed partitions would not."""
    pick = np.random.default_rng(7)
    sample = pick.integers(0, 2 ** 63, 2048).astype(np.uint64) * np.uint64(2) + pick.integers(0, 2, 2048).astype(np.uint64)
    shares, none = np.full(64, 0.5), np.eye(64)
    costs = {n: simhash.choose_layout(none, shares, n, sample, 4) for n in (10 ** 4, 10 ** 5, 10 ** 6, 10 ** 7, 10 ** 8, 10 ** 9)}
    assert [len(costs[n][0]) for n in sorted(costs)] == sorted((len(costs[n][0]) for n in costs), reverse=True)
    assert max(c[2] for c in costs.values()) < 1000 and costs[10 ** 7][2] < 10 * costs[10 ** 5][2]
    assert simhash.choose_layout(none, shares, 10 ** 9, sample, 4, 4)[2] > 100_000
    assert all(sum(t + 1 for t in c[1]) == 5 and sorted(b for g in c[0] for b in g) == list(range(64)) for c in costs.values())


def test_estimated_candidates_are_those_counted():
    pick = np.random.default_rng(3)
    prints = pick.integers(0, 2 ** 63, 3000).astype(np.uint64)
    bits = list(range(10, 22))
    shares = np.array([((prints >> np.uint64(b)) & np.uint64(1)).mean() for b in range(64)])
    own = (prints >> np.uint64(10)) & np.uint64(0xFFF)
    apart = np.bitwise_count(own[:, None] ^ own[None, :])
    for t, share in enumerate(simhash.pair_shares(prints[:1500], shares, bits, 2)):
        exact = ((apart <= t).sum() - len(own)) / (len(own) * (len(own) - 1))
        assert 0.8 * exact < share < 1.3 * exact


def test_near_duplicates(messy, varied):
    for docs in (messy, varied):
        rows = docs.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in rows]
        root = plain_components(dict.fromkeys(prints), 4)
        least = {}
        for r, p in zip(rows, prints):
            ids = [i for i in (least.get(root[p]), r.doc_id) if i is not None]
            least[root[p]] = min(ids) if ids else None
        want = sorted(((r.doc_id, f"{p:016x}", least[root[p]]) for r, p in zip(rows, prints)), key=str)
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == want


def test_near_drop_and_empty(varied, empty):
    found = simhash.near_duplicates(varied).collect()
    kept = simhash.drop_near_duplicates(varied)
    assert kept.columns == varied.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in found})
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []


def test_near_drop_keeps_one_row_of_null_and_repeated_ids(messy, spark):
    pick = random.Random(6)
    a, b, c = (" ".join(pick.choices([f"w{i}" for i in range(500)], k=60)) for _ in range(3))
    docs = spark.createDataFrame([(None, a), (None, a), (7, a), (7, a), (7, b), (3, b), (None, c), (None, c)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()), key=str) == sorted([(7, a), (3, b), (None, c)], key=str)
    prints = [plain_fingerprint(r.text) for r in messy.select("text").collect()]
    assert simhash.drop_near_duplicates(messy).count() == len(set(plain_components(dict.fromkeys(prints), 4).values()))


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 300), (900, 900)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 300, 400: 300}
