"""Classifiers by held-out accuracy, the language model by exact counts, the pipeline stage by stage."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, exact_dedup, labelled, language_model, mix, quality, queries, simhash, toxicity


@pytest.fixture(scope="module")
def marked(spark):
    """Texts with a planted insult are toxic; shouting, repeated or junk texts are of low quality."""
    pick = random.Random(11)
    words = ["river", "stone", "quiet", "garden", "letter", "window", "paper", "morning", "yellow", "engine", "harbour", "signal"]
    rows, labels = [], []
    for i in range(900):
        text = pick.choices(words, k=pick.randint(8, 300))
        toxic, low = i % 9 == 0, i % 7 == 0
        if toxic:
            text.insert(pick.randrange(len(text)), pick.choice(["zorkface", "blurghead"]))
        if low:
            text = [w.upper() + "!!" for w in text] if i % 2 else [w for w in text[:30] for _ in range(20)]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not low), int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def held_out_accuracy(scored, labels, column, threshold):
    got = {r.doc_id: r.score >= threshold for r in scored.collect()}
    seen = [(got[r.doc_id], bool(r[column])) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    return sum(a == b for a, b in seen) / len(seen)


def test_toxicity_held_out(marked):
    docs, labels = marked
    model = toxicity.train_toxicity(docs, labels, ~queries.held_out(5, 0))
    assert held_out_accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", 0.5) > 0.97


def test_quality_held_out(marked):
    docs, labels = marked
    model = quality.train_quality(docs, labels, ~queries.held_out(5, 0))
    assert held_out_accuracy(quality.score_quality(docs, model), labels, "quality", 0.7) > 0.97
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score_quality(docs, model).collect() if r.score >= 0.7}


def test_held_out_labels_are_not_read(marked):
    docs, labels = marked
    flipped = labels.withColumn("toxic", F.when(queries.held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.train_toxicity(docs, x, ~queries.held_out(5, 0)) for x in (labels, flipped))
    assert np.array_equal(one.buckets, two.buckets) and np.array_equal(one.weights, two.weights)


def test_classifiers_on_messy_rows(messy, empty, marked, spark):
    docs, labels = marked
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (3, 1, 0), (3, 0, 1)], labels.schema))
    for train, score, column in ((toxicity.train_toxicity, toxicity.score_toxicity, "toxic"), (quality.train_quality, quality.score_quality, "quality")):
        model = train(docs, odd, F.lit(True))
        for m in (model, train(empty, odd, F.lit(True)), train(docs, odd.where(f"{column} = 1"), F.lit(True)), train(docs, odd.limit(0), F.lit(True))):
            rows = score(messy, m).collect()
            assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
            assert len({r.score for r in rows if r.doc_id == 5}) == 1
        assert score(empty, model).collect() == []


def test_long_texts_score_by_blocks(monkeypatch):
    text = " ".join(f"w{i % 50} A{i % 7}" for i in range(3000)) + " same same same Same" * 40
    for module, grams, bound, size in ((toxicity, toxicity.character_grams, "_BLOCK", 5000), (quality, quality.word_grams, "_BLOCK_WORDS", 5000),
                                       (quality, quality.word_grams, "_BLOCK_WORDS", 4), (quality, quality.word_grams, "_BLOCK_WORDS", 1)):
        monkeypatch.setattr(module, bound, 1 << 20)
        whole = {int(b) for part in next(iter(grams([text]))) for b in part}
        monkeypatch.setattr(module, bound, size)
        blocks = {int(b) for part in next(iter(grams([text]))) for b in part}
        # Blocks overlap by what an n-gram needs, and no word is cut.
        assert whole == blocks


def plain_counts(rows, grams):
    """Documents of either class that have a feature, one by one."""
    counts = {}
    for text, label in rows:
        for bucket in {int(b) for part in next(iter(grams([text]))) for b in part}:
            counts.setdefault(bucket, [0, 0])[label] += 1
    return counts


@pytest.mark.parametrize("module, grams", [("toxic", toxicity.character_grams), ("quality", quality.word_grams)])
def test_counts_and_ratios(spark, marked, module, grams):
    docs, labels = marked
    labelled_rows = docs.select("doc_id", "text").join(labels, "doc_id").selectExpr("doc_id", "text", f"{module} as label").limit(60)
    rows = [(r.text, r.label) for r in labelled_rows.collect()]
    sample = spark.createDataFrame([(i, y, t) for i, (t, y) in enumerate(rows)], "doc_id long, label int, text string")
    want = plain_counts(rows, grams)
    counts = labelled.count_features(sample, grams)
    assert {r.bucket: [r.n0, r.n1] for r in counts.collect()} == want
    totals = (sum(y == 0 for _, y in rows), sum(y == 1 for _, y in rows))
    ratio = {b: math.log((n1 + 1) / (totals[1] + 2)) - math.log((n0 + 1) / (totals[0] + 2)) for b, (n0, n1) in want.items()}
    ranked = sorted((b for b, n in want.items() if sum(n) >= 3), key=lambda b: (-round(abs(ratio[b]) * math.sqrt(sum(want[b])), 9), b))[:40]
    chosen = labelled.select_features(counts, totals, size=40)
    assert len(set(chosen.buckets.tolist()) ^ set(ranked)) <= 2  # ties at the end of the list
    assert all(abs(r - ratio[int(b)]) < 1e-9 for b, r in zip(chosen.buckets, chosen.ratios))


def test_hinge_loss_is_least():
    """Dual coordinate descent ends where no small step lowers the loss it is meant to lower."""
    pick = np.random.default_rng(4)
    ratios = pick.normal(size=30)
    rows = [np.flatnonzero(pick.random(30) < 0.3) for _ in range(80)]
    labels = np.array([int(ratios[r].sum() + pick.normal() > 0) for r in rows])
    weights, bias = quality.fit_hinge(labels, rows, ratios, cost=0.5, rounds=3000)
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    x[:, -1] = 1
    signs = labels * 2.0 - 1

    def loss(w):
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - signs * (x @ w)).sum()

    best = np.append(weights / ratios, bias)
    assert all(loss(best + 0.02 * d) > loss(best) - 1e-3 for d in pick.normal(size=(300, 31)) / 5)
    assert loss(best) < loss(best * 0.9) and loss(best) < loss(best * 1.1)


def test_logistic_loss_is_least():
    pick = np.random.default_rng(6)
    ratios = pick.normal(size=20)
    rows = [np.flatnonzero(pick.random(20) < 0.4) for _ in range(60)]
    labels = np.array([int(ratios[r].sum() + pick.normal() > 0) for r in rows])
    weights, bias = toxicity.fit_logistic(labels, rows, ratios)
    x = np.zeros((60, 20))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r]
    w = weights / ratios
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (p - labels) + w).max() < 1e-2 and abs((p - labels).sum()) < 1e-2


def test_log_levels():
    counts = np.array([1, 2, 3, 4, 7, 8, 1000])
    levels = language_model.quantise(counts, 2.0)
    assert levels.tolist() == [1, 2, 2, 3, 3, 4, 10]
    assert language_model.level_counts(2.0)[levels].tolist()[:6] == [1, 2.5, 2.5, 5.5, 5.5, 11.5]


def test_filter_reads_back_counts(spark):
    pick = np.random.default_rng(3)
    grams = np.sort(np.unique(pick.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2)))
    counts = np.minimum(pick.zipf(1.5, len(grams)), 10**6)
    for bits in (0, 3):
        halves = [language_model._pack_counts(grams, counts, bits), language_model._pack_counts(grams[::2], counts[::2], bits)]
        rows = [tuple(r.values()) for h in halves for r in h.to_pylist()]
        built = language_model.build_segments(spark.createDataFrame(rows, language_model._PACKED), 2.0, 10.0)
        held = language_model.SharedFilter(built, 0, (1 << bits) - 1, bits, 2.0).made('pairs')
        total = counts.copy()
        total[::2] *= 2
        found = held.counts(grams)
        want = language_model.level_counts(2.0)[language_model.quantise(total, 2.0)]
        assert (found >= want).all() and (found == want).mean() > 0.95  # a false hit may only raise a count
        strange = held.counts(pick.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        assert (strange > 0).mean() < 0.06


def test_false_hits_at_the_default_size(spark):
    pick = np.random.default_rng(8)
    grams = np.unique(pick.integers(0, 2**63, 50_000).astype(np.uint64) * np.uint64(2))
    rows = [tuple(r.values()) for r in language_model._pack_counts(grams, np.ones(len(grams), np.int64), 0).to_pylist()]
    built = language_model.build_segments(spark.createDataFrame(rows, language_model._PACKED), 2.0, language_model.BITS_PER_ENTRY)
    held = language_model.SharedFilter(built, 0, 0, 0, 2.0).made('pairs')
    strange = held.counts(pick.integers(0, 2**63, 200_000).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    assert (strange > 0).mean() < 0.039  # 3.6 % with four hashes at 7 bits, 4.2 % with three


def plain_base(rows):
    train = Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            train.update(language_model.tokens(r.text))
    total, distinct = sum(train.values()), len(train)
    out = []
    for r in rows:
        words = language_model.tokens(r.text)
        out.append((r.doc_id, len(words), sum(train[w] > 0 for w in words), total,
                    round(math.fsum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words), 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [{}, {"head_words": 2, "max_filter_bytes": 400, "segment_grams": 100}])
def test_language_model(messy, varied, empty, small):
    for docs in (messy, varied):
        got = language_model.score_texts(docs, ~queries.held_out(10, 0), **small).collect()
        assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == plain_base(
            docs.select("doc_id", "text").collect())
        assert all(r.score < 0 and r.score == r.score for r in got)
    assert language_model.score_texts(empty, F.lit(True)).collect() == []
    assert len(language_model.score_texts(varied, F.lit(False)).collect()) == varied.count()


def plain_scores(rows, mass=language_model.MASS):
    """log10 probabilities from exact counts, each replaced by what its level stands for."""
    train, pairs, texts = Counter(), Counter(), 0
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10:
            words, texts = language_model.tokens(r.text), texts + 1
            train.update(words)
            pairs.update(zip([None, *words], words))
    total, distinct = sum(train.values()), len(train)

    def known(n):
        return language_model.level_counts(2.0)[language_model.quantise(np.array([n]), 2.0)[0]] if n else 0.0

    out = []
    for r in rows:
        score, words = 0.0, language_model.tokens(r.text)
        for before, word in zip([None, *words], words):
            history = texts if before is None else known(train[before])
            together = min(known(pairs[before, word]), history)
            score += math.log10((together + mass * (known(train[word]) + 0.1) / (total + 0.1 * (distinct + 1))) / (history + mass))
        out.append((r.doc_id, round(score, 6)))
    return sorted(out, key=str)


def test_scores_of_exact_counts(messy, varied):
    """With hardly any false hits the filter's scores are those of exact pair counts."""
    for docs in (messy, varied):
        got = language_model.score_texts(docs, ~queries.held_out(10, 0), bits_per_entry=200.0).collect()
        assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == plain_scores(docs.select("doc_id", "text").collect())


def test_counts_beyond_32_bits(spark):
    grams, counts = np.array([5 << 40, 9 << 40], np.uint64), np.array([1 << 40, 3])
    rows = [tuple(r.values()) for r in language_model._pack_counts(grams, counts, 0).to_pylist()]
    built = language_model.build_segments(spark.createDataFrame(rows, language_model._PACKED), 2.0, 100.0)
    held = language_model.SharedFilter(built, 0, 0, 0, 2.0).made("pairs")
    assert held.levels(grams).tolist() == [41, 2]


def test_workers_map_the_filter(spark):
    """A worker maps the bytes of the broadcast, and finds in them what was sent."""
    sent = spark.sparkContext.broadcast(bytes(range(256)) * 5000)

    def look(_):
        data = language_model.mapped_bytes(sent)
        yield type(data).__name__, len(data), int(data[:256].astype(int).sum()), int(data[-1])

    assert set(spark.sparkContext.parallelize(range(2), 2).mapPartitions(look).collect()) == {("memmap", 1_280_000, 32_640, 255)}
    assert len(language_model.mapped_bytes(sent)) == 1_280_000


def test_scores_do_not_depend_on_the_filter_bound(spark):
    """Parts of the filters of words and pairs give the scores of whole ones: no entry gets fewer bits."""
    pick = random.Random(4)
    words = [f"word{i}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(pick.choices(words, k=pick.randint(0, 80)))) for i in range(200)] + [(None, None)],
                                 "doc_id long, text string")
    whole, parts = (sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.score, 6)) for r in language_model.score_texts(
        docs, ~queries.held_out(10, 0), segment_grams=300, max_filter_bytes=bound).collect()), key=str) for bound in (1 << 20, 1500))
    assert whole == parts


def test_bad_words_cost_more(varied, spark):
    more = varied.select("doc_id", "text").unionByName(spark.createDataFrame([(1000, "Été alpha Beta 42"), (1001, "zzz qqq vvv kkk")], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in language_model.score_texts(more, F.col("doc_id") < 1000).collect()}
    assert got[1000] > got[1001]


def test_pipeline_stage_by_stage(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, sf)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    judged = [(i in kept, bool(q)) for i, q in labels.items() if q is not None]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9
    exact = corpus_pipeline.exact_stage(spark, good, sf)
    want = {r.doc_id for r in exact_dedup.exact_duplicates(good).collect() if r.kept}
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == sorted(want)
    near = corpus_pipeline.near_stage(spark, exact, sf)
    want = {r.component_id for r in simhash.near_duplicates(exact).collect()}
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == sorted(want)
    mixed = corpus_pipeline.mixing_stage(spark, near, sf)
    copies = Counter(r.doc_id for r in mixed.collect())
    again = Counter(r.doc_id for r in mix.mix_sources(near, corpus_pipeline.MIX_WEIGHTS, corpus_pipeline.MIX_OTHER, seed=corpus_pipeline.MIX_SEED).collect())
    assert mixed.columns == docs.columns and copies == again and set(copies) <= want
    encoded = corpus_pipeline.encoding_stage(spark, mixed, sf).collect()
    assert Counter(r.doc_id for r in encoded) == copies
    tokenizer = bpe.WordTokenizer.of(queries.public_tokenizers.path(corpus_pipeline.TOKENIZER)).tokenizer
    texts = {r.doc_id: r.text for r in near.collect()}
    assert all(r.n_tokens == len(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) for r in encoded)
