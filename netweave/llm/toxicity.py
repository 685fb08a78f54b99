"""Toxicity: a character n-gram linear classifier with naive Bayes features.

A document's features are the hashed character n-grams of its words (in angle
brackets, lower case).  A feature's value is how often the n-gram occurs per
word of the text, scaled by its naive Bayes log-count ratio, which is smoothed
towards the class balance.  Only n-grams that tell the classes apart with some
certainty are features: with all of them, a few hundred texts of the rare class
are learned by heart.  A logistic regression is trained on the scaled features
by stochastic gradient descent.

Defined results: null text counts as empty; an empty text has the score of the
bias alone; without any labelled row every score is 0.5; repeated rows each get
a row; extra columns are ignored; an empty table gives none.  Very long texts and
words count whole: n-grams are made and counted in stretches, so that memory
follows the text, not its n-grams.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netweave.llm.common import arrow_map, gram_counts, slices
from netweave.llm.labelled import MAX_ROWS, training_rows

BUCKETS = 1 << 20
MIN_GRAM, MAX_GRAM = 3, 6
#: A value is SCALE times the occurrences per word.
SCALE = 30.0
#: Pseudo-documents by which each ratio is pulled to the class balance.
SMOOTH = 30.0
#: N-grams of fewer training texts, with a ratio nearer to 0, or that tell the classes apart by fewer standard errors, are no features.
MIN_TEXTS, MIN_RATIO = 3, 0.6
MIN_SURE = 3.0
EPOCHS = 12
#: Most that a row of the rarer class weighs in the loss.
MOST_WEIGHT = 8.0
RATE = 0.2
DECAY = 1e-3
#: Texts whose n-grams are looked at together; bounds the memory of a step.
STEP = 64


#: ASCII letters in lower case, everything else of ASCII as a space; other bytes stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def values(texts: list[str], live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of every n-gram of the texts, by text; only ``live`` buckets if given."""
    counts = [Counter(t.encode().translate(_LETTERS).split()) for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
    if not place:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    owner, bucket, often = gram_counts(list(place), MIN_GRAM, MAX_GRAM, BUCKETS, live)
    first = np.searchsorted(owner, np.arange(len(place) + 1))
    word = np.fromiter((place[w] for c in counts for w in c), np.int64)
    times = np.fromiter((n for c in counts for n in c.values()), np.float64)
    text = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    size = first[word + 1] - first[word]
    # The n-grams of each (text, word), one after the other.
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[word], size)
    key, inverse = np.unique(np.repeat(text, size) * BUCKETS + bucket[at], return_inverse=True)
    total = np.bincount(inverse, np.repeat(times, size) * often[at], len(key))
    n_words = np.array([max(1, sum(c.values())) for c in counts], float)
    return key // BUCKETS, key % BUCKETS, SCALE * total / n_words[key // BUCKETS]


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(buckets that count, their weights, bias)."""
    if not texts:
        return np.zeros(0, np.int32), np.zeros(0), 0.0
    docs = []
    for at in range(0, len(texts), STEP):
        part = texts[at : at + STEP]
        text, bucket, value = values(part)
        ends = np.searchsorted(text, np.arange(len(part) + 1))
        docs += [(bucket[i:j].astype(np.int32), value[i:j].astype(np.float32)) for i, j in zip(ends[:-1], ends[1:])]
    y = np.array(labels)
    mass, seen = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for (b, v), label in zip(docs, y):
        mass[label][b] += v
        seen[label][b] += 1
    n1 = int(y.sum())
    usual = mass.sum(0) / len(y)
    ratio = np.log((mass[1] + SMOOTH * usual + 1e-9) / (n1 + SMOOTH)) - np.log((mass[0] + SMOOTH * usual + 1e-9) / (len(y) - n1 + SMOOTH))
    # How far the share of texts with the n-gram differs between the classes, in standard errors of its log-odds.
    odds = np.log(seen[1] + 0.5) - np.log(n1 - seen[1] + 0.5) - np.log(seen[0] + 0.5) + np.log(len(y) - n1 - seen[0] + 0.5)
    sure = np.abs(odds) / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    ratio[(seen.sum(0) < MIN_TEXTS) | (np.abs(ratio) < MIN_RATIO) | (sure < MIN_SURE)] = 0
    for i, (b, v) in enumerate(docs):
        used = ratio[b] != 0
        docs[i] = (b[used], (v[used] * ratio[b[used]]).astype(np.float32))
    rng = np.random.default_rng(seed)
    # Both classes weigh the same in the loss: the rare one has to be found.
    weigh = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    w, bias, squares, step = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-2), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            b, x = docs[i]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + float(w[b] @ x)))))
            g = float(min(weigh[y[i]], MOST_WEIGHT)) * (p - y[i])
            step += 1
            bias -= 0.05 * g / math.sqrt(1 + step / len(docs))
            gx = g * x + DECAY * w[b]
            squares[b] += gx * gx
            w[b] -= RATE * gx / np.sqrt(squares[b])
    weights = w * ratio
    live = np.flatnonzero(weights)
    return live.astype(np.int32), weights[live], bias


class Scorer:
    """Scores texts by a table of weights."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, bias: float):
        self.bias, self.table = bias, np.zeros(BUCKETS)
        self.table[buckets] = weights
        self.live = self.table != 0

    def scores(self, texts: list[str]) -> list[float]:
        text, bucket, value = values(texts, self.live)
        z = self.bias + np.bincount(text, self.table[bucket] * value, len(texts))
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text: str = "text", rows: int = MAX_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on at most ``rows`` labelled rows outside the held-out fold."""
    return train(*training_rows(docs, labels, label, id_col, text, rows))


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # n-grams of a bounded sample, in BUCKETS at most
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in slices(batches, STEP):
            got = pa.array(scorer.scores([x or "" for x in b.column(1).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=[id_col, "score"])

    return arrow_map(docs.select(id_col, text), run, f"`{id_col}` {kind}, score double")
