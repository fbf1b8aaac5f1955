"""Toxicity scores of whole texts.

Method: character n-grams (3 to 6 code points, lower-cased) that occur in a
text are indicators, each scaled by its naive Bayes log-count ratio; a logistic
linear model over them is fitted by Newton steps with conjugate gradients.

Defined results: a null or empty text has no features and scores by the bias
alone; with labels of one class or none every text scores that class's smoothed
share (0.5 without labels); repeated rows stay repeated; ids may be null; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from tidemark.llm.common import pick
from tidemark.llm.labelled import BUCKET_BITS, MAX_ROWS, SIZE, Linear, feature_training, score_texts

ORDERS = (3, 4, 5, 6)
_BLOCK = 1 << 20


def character_grams(texts: list[str]) -> Iterator[Iterator[np.ndarray]]:
    """Buckets of all character n-grams, block by block, so long texts need no more memory."""

    def parts(text: str) -> Iterator[np.ndarray]:
        points = np.frombuffer(text.lower().encode("utf-32-le"), "<u4")
        for first in range(0, len(points), _BLOCK):
            block = points[first:first + _BLOCK + max(ORDERS) - 1]
            hashed = block * np.uint32(0x01000193)
            for order in range(2, max(ORDERS) + 1):
                if len(block) < order:
                    break
                hashed = (hashed[:-1] ^ block[order - 1:]) * np.uint32(0x01000193)
                hashed = hashed ^ (hashed >> np.uint32(15))
                if order in ORDERS:
                    yield (hashed * np.uint32(0x9E3779B1) + np.uint32(order * 0x05EBCA6B)) >> np.uint32(32 - BUCKET_BITS)

    return map(parts, texts)


def fit_logistic(labels: np.ndarray, rows: list[np.ndarray], ratios: np.ndarray, ridge: float = 1.0,
                 steps: int = 25) -> tuple[np.ndarray, float]:
    """Weights of the plain indicators (ratio times fitted weight) and the bias."""
    sizes = np.array([len(r) for r in rows])
    columns = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    values = ratios[columns]
    signs = labels * 2.0 - 1.0

    def times(w):
        return np.bincount(owner, values * w[columns], len(rows)) + w[-1]

    def back(v):
        out = np.bincount(columns, values * v[owner], len(ratios) + 1)
        out[-1] = v.sum()
        return out

    penalty = np.full(len(ratios) + 1, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(len(ratios) + 1)

    def loss(w):
        return np.logaddexp(0, -signs * times(w)).sum() + (penalty * w * w).sum() / 2

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        slope = back(p - labels) + penalty * w
        curve = p * (1 - p)
        move, rest = np.zeros_like(w), -slope
        along, size = rest.copy(), rest @ rest
        target = 1e-4 * size
        for _ in range(60):
            if size <= target:
                break
            bent = back(curve * times(along)) + penalty * along
            length = size / (along @ bent)
            move += length * along
            rest -= length * bent
            grown = rest @ rest
            along, size = rest + (grown / size) * along, grown
        length = 1.0
        while length > 1e-6 and loss(w + length * move) > now + 1e-4 * length * (slope @ move):
            length /= 2
        w = w + length * move
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w[:-1] * ratios, float(w[-1])


def train_toxicity(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", id_col: str = "doc_id",
                   text_col: str = "text", max_rows: int = MAX_ROWS, size: int = SIZE) -> Linear:
    """A model of the labels that `keep`, a condition on doc_id, admits; at most `max_rows` of them are used."""
    selected, classes, rows = feature_training(docs, labels, label_col, keep, character_grams, size, max_rows, id_col, text_col)
    if len(set(classes.tolist())) < 2:
        share = (classes.sum() + 1) / (len(classes) + 2)
        return Linear(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    weights, bias = fit_logistic(classes, rows, selected.ratios)
    return Linear(selected.buckets, weights, bias)


def score_toxicity(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a higher score makes the label 1 likelier."""
    return score_texts(pick(docs, doc_id=id_col, text=text_col), character_grams, model)
