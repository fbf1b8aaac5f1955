"""Quality scores of whole texts by naive Bayes support vectors.

Method: word n-grams that occur in a text are indicators, each scaled by its
naive Bayes log-count ratio; a linear model with hinge loss is fitted by dual
coordinate descent, and a logistic curve over out-of-fold margins turns margins
into probabilities. N-grams are single words, pairs of words, and triples of
word forms (letter case, digits, the signs themselves, and whether a word
repeats the one before).

Defined results: a null or empty text has no features and scores by the bias
alone; with labels of one class or none every text scores that class's smoothed
share (0.5 without labels); repeated rows stay repeated; ids may be null; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame

from tidemark.llm.common import pick
from tidemark.llm.labelled import BUCKET_BITS, MAX_ROWS, SIZE, Linear, feature_training, keep_texts, score_texts

_WORDS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_BLOCK_WORDS = 1 << 18


def _form(word: str) -> str:
    if word[0].isalpha():
        return "a" if word.islower() else "A" if word.isupper() and len(word) > 1 else "Aa" if word[0].isupper() else "aA"
    return "0" if word[0].isdigit() else word


def _bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def word_grams(texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
    """Buckets of all word n-grams, a block of words at a time; the blocks make no difference to the set."""
    known: dict[str, int] = {}
    forms: dict[str, int] = {}

    def numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > 200_000:
            known.clear()
            forms.clear()
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
            forms[word] = xxhash.xxh64_intdigest("form " + _form(word))
        return (np.fromiter(map(known.__getitem__, words), np.uint64, len(words)),
                np.fromiter(map(forms.__getitem__, words), np.uint64, len(words)))

    def parts(text: str) -> Iterator[np.ndarray]:
        # a block begins with the last three words before it; the first of them only tells whether the second repeats it
        last, factor = (np.empty(0, np.uint64), np.empty(0, np.uint64)), np.uint64(0x9E3779B97F4A7C15)
        found = (match[0] for match in _WORDS.finditer(text))
        while words := list(itertools.islice(found, _BLOCK_WORDS)):
            known_before = 1 if len(last[0]) == 3 else 0
            own, form = (np.concatenate(both) for both in zip(last, numbers(words)))
            last = own[-3:], form[-3:]
            repeats = np.concatenate([[False], own[1:] == own[:-1]])
            form = np.where(repeats, form * np.uint64(31) + np.uint64(7), form)[known_before:]
            same = np.where(repeats, np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A5A5A5A5A5))[known_before:]
            yield _bucket(own)
            yield _bucket(own[:-1] * factor + own[1:])
            yield _bucket((form[:-2] * factor + form[1:-1]) * factor + form[2:])
            yield _bucket((same[:-2] * factor + same[1:-1]) * factor + same[2:])

    return map(parts, texts)


def fit_hinge(labels: np.ndarray, rows: list[np.ndarray], ratios: np.ndarray, cost: float = 0.1, rounds: int = 40,
              seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights of the plain indicators and the bias: dual coordinate descent on the hinge loss.

    Rows have length one, so no text weighs more for being long in training.
    """
    signs = labels * 2.0 - 1.0
    values = [ratios[r] for r in rows]
    norms = np.array([v @ v for v in values]) + 1.0
    w, bias, dual = np.zeros(len(ratios)), 0.0, np.zeros(len(rows))
    shuffled = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in shuffled.permutation(len(rows)).tolist():
            row, x = rows[i], values[i]
            slope = signs[i] * (w[row] @ x + bias) - 1
            if (dual[i] <= 0 and slope >= 0) or (dual[i] >= cost and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            moved = min(max(dual[i] - slope / norms[i], 0.0), cost)
            step = (moved - dual[i]) * signs[i]
            dual[i] = moved
            w[row] += step * x
            bias += step
        if worst < 0.01:
            break
    return w * ratios, bias


def fit_curve(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve over margins, with smoothed targets."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    x = np.stack([margins, np.ones(len(margins))])

    def loss(w):
        z = w @ x
        return (np.logaddexp(0, z) - target * z).sum()

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -500, 500)))
        slope = x @ (p - target)
        move = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), -slope)
        length = 1.0
        while length > 1e-8 and loss(w + length * move) > loss(w):
            length /= 2
        w = w + length * move
        if np.abs(slope).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def train_quality(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", max_rows: int = MAX_ROWS, size: int = SIZE, folds: int = 3) -> Linear:
    """A model of the labels that `keep`, a condition on doc_id, admits; at most `max_rows` of them are used."""
    selected, classes, rows = feature_training(docs, labels, label_col, keep, word_grams, size, max_rows, id_col, text_col)
    if len(set(classes.tolist())) < 2:
        share = (classes.sum() + 1) / (len(classes) + 2)
        return Linear(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    for fold in range(folds):
        inner = [i for i in range(len(rows)) if i % folds != fold]
        weights, bias = fit_hinge(classes[inner], [rows[i] for i in inner], selected.ratios)
        for i in range(fold, len(rows), folds):
            margins[i] = weights[rows[i]].sum() + bias
    slope, shift = fit_curve(margins, classes)
    weights, bias = fit_hinge(classes, rows, selected.ratios)
    return Linear(selected.buckets, weights, bias, max(slope, 1e-3), shift)


def score_quality(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a higher score makes the label 1 likelier."""
    return score_texts(pick(docs, doc_id=id_col, text=text_col), word_grams, model)


def keep_quality(docs: DataFrame, model: Linear, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least `threshold`, with all their columns."""
    return keep_texts(docs, word_grams, model, threshold, text_col)
