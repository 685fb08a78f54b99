"""Quality classifier: supervised subword embeddings.

A document is a bag of hashed features: its words, the character n-grams of
each word in angle brackets, and a mark for a word that repeats the one before
it.  Their learned vectors are averaged and go through a softmax over the two
classes; vectors and weights are trained by stochastic gradient descent in
numpy on a bounded labelled sample.

For scoring, the softmax of two classes needs one number per feature (its
vector times the difference of the class weights), so a document's score is a
sum over words that each worker looks up in a table.

Defined results: null text counts as empty; an empty text has the score of the
bias alone; without any labelled row every score is 0.5; repeated rows each get
a row; extra columns are ignored; an empty table gives none.  Very long texts and
words count whole: n-grams are made and counted in stretches, so that memory
follows the text, not its n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import MEMO_ROWS, MEMO_WORD, arrow_map, gram_counts, held_out, slices
from netweave.llm.labelled import training_rows

#: Most labelled rows that are trained on (a bound).
MAX_ROWS = 3000
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 5
RATE = 0.4
MIN_GRAM, MAX_GRAM = 3, 4
AGAIN = 0  # bucket of "the word before once more"
STEP = 64  # training texts whose features are made together


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, bucket, times), by word: each word and its character n-grams."""
    owner, bucket, times = gram_counts(words, MIN_GRAM, MAX_GRAM, BUCKETS - 1)
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64) % np.uint64(BUCKETS - 1)
    owner, bucket = np.concatenate([np.arange(len(words)), owner]), np.concatenate([own.astype(np.int64), bucket]) + 1
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order], np.concatenate([np.ones(len(words), np.int64), times])[order]


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares; some texts at a time, so that what is made on the way stays small."""
    return [bag for at in range(0, len(texts), STEP) for bag in _some_bags(texts[at : at + STEP])]


def _some_bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    split = [t.encode().split() for t in texts]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for p in split for w in p))}
    if not place:
        return [(np.zeros(0, np.int32), np.zeros(0, np.float32)) for _ in texts]
    owner, bucket, times = word_features(list(place))
    first = np.searchsorted(owner, np.arange(len(place) + 1))
    out = []
    for p in split:
        at = np.array([place[w] for w in p], np.int64)
        word, seen = np.unique(at, return_counts=True)
        again = int((at[1:] == at[:-1]).sum())
        ids = np.concatenate([np.full(min(again, 1), AGAIN), *(bucket[first[i] : first[i + 1]] for i in word)])
        n = np.concatenate([np.full(min(again, 1), again), *(k * times[first[i] : first[i + 1]] for i, k in zip(word, seen))])
        found, inverse = np.unique(ids, return_inverse=True)
        n = np.bincount(inverse, n, len(found))
        out.append((found.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Learned numbers per bucket, and the bias: the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = rng.uniform(-0.5, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    bags = _bags(texts)
    y = np.array(labels)
    if not len(y):
        return np.zeros(BUCKETS, np.float32), 0.0
    # Both classes weigh the same in the loss, so 0.5 is a fair cut for the rare one.
    weigh = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rate = RATE * (1 - step / steps)
            step += 1
            ids, share = bags[i]
            hidden = share @ vectors[ids]
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            grad = (rate * min(weigh[y[i]], 5.0)) * p
            back = weights @ grad
            weights -= np.outer(hidden, grad)
            bias -= grad * 0.1
            vectors[ids] -= (share[:, None] * back) * 20  # averaged inputs: a larger step for the vectors
    difference = weights[:, 1] - weights[:, 0]
    return (vectors @ difference).astype(np.float32), float(bias[1] - bias[0])


class Scorer:
    """Scores texts by a table: word -> sum over its features (real) and their number (imaginary)."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias, self.words = table, bias, {}

    def learn(self, words: list[bytes]) -> None:
        owner, bucket, times = word_features(words)
        total = np.bincount(owner, self.table[bucket] * times, len(words)) + 1j * np.bincount(owner, times, len(words))
        self.words.update(zip(words, total.tolist()))

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.encode().split() for t in texts]
        if len(self.words) > MEMO_ROWS:
            self.words.clear()
        new = list(set().union(*split).difference(self.words))
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        out = [self._score(p) for p in split]
        for w in new:
            if len(w) > MEMO_WORD:  # a text without spaces is one word: not to be kept
                del self.words[w]
        return out

    def _score(self, words: list[bytes]) -> float:
        total = sum(map(self.words.__getitem__, words), 0j)
        again = sum(map(bytes.__eq__, words[1:], words))
        n = total.imag + again
        z = self.bias + ((total.real + again * float(self.table[AGAIN])) / n if n else 0.0)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = MAX_ROWS) -> tuple[np.ndarray, float]:
    """Train on at most ``rows`` labelled rows outside the held-out fold."""
    return train(*training_rows(docs, labels, label, id_col, text, rows))


def score(docs: DataFrame, model: tuple, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id_col``, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers: a fixed size
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in slices(batches):
            got = pa.array(scorer.scores([x or "" for x in b.column(1).to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), got], names=[id_col, "score"])

    return arrow_map(docs.select(id_col, text), run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: tuple, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for b in slices(batches):
            yield b.filter(pa.array([x >= least for x in scorer.scores([x or "" for x in b.column(at).to_pylist()])], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def verdicts(scored: DataFrame, id_col: str = "doc_id", cut: float = 0.5) -> DataFrame:
    """Scores with their fold and the predicted label."""
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
