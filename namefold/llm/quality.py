"""Quality by supervised subword embeddings, learned by numpy stochastic gradient descent.

A token (a run between white space) has the mean of the vectors of its hashed parts: the whole word and its
character n-grams with word borders. A word pair of equal neighbours is one more token, the repeat. A
document has the mean of its tokens' vectors, and a softmax over the classes gives its score.

Learns from at most ``sample`` labelled documents, never from held-out ones. Defined cases: null and empty
texts have the score of the mean vector 0, that is, of the bias; without labels of both kinds every score is
0.5; repeated rows each give a row; a null doc_id is not held out; very long texts are scored whole; empty tables
give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from namefold.llm.learning import Remembered, fold, give_back, labelled_sample, scored

BUCKETS, DIMENSION, EPOCHS, RATE, BATCH = 1 << 17, 8, 6, 4.0, 32
#: Documents learned from, at most.
SAMPLE = 3000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
REPEAT = "\0repeat"


def parts(word: str) -> list[int]:
    """Hashed parts of a token: itself and its character n-grams of two and three with borders."""
    if word == REPEAT:
        return [zlib.crc32(word.encode()) % BUCKETS]
    data = b"<" + word.encode() + b">"
    grams = {data[k : k + n] for n in (2, 3) for k in range(len(data) - n + 1)}
    return [zlib.crc32(g) % BUCKETS for g in (data, *sorted(grams))]


def tokens(text: str) -> tuple[list[str], int]:
    """Tokens and the number of repeats among them."""
    words = text.split()
    return words, sum(map(operator.eq, words, words[1:]))


def _features(text: str, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, weight) of a document; the weights of all parts add up to 1."""
    words, repeats = tokens(text)
    counts = Counter(words)
    if repeats:
        counts[REPEAT] = repeats
    total = len(words) + repeats
    ids = [known[w] for w in counts]
    if not ids:
        return np.empty(0, dtype=np.int64), np.empty(0)
    weight = np.repeat([n / total / len(i) for n, i in zip(counts.values(), ids, strict=True)], [len(i) for i in ids])
    bucket, at = np.unique(np.concatenate(ids), return_inverse=True)
    return bucket, np.bincount(at, weights=weight)


def train(documents: list[str], labels: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias): the score of a document is the logistic of its mean value and the bias.

    Of two softmax outputs only the difference counts, so the vectors are folded into one value each.
    """
    known = Remembered(lambda w: np.array(parts(w), dtype=np.int64))
    features = [_features(x, known) for x in documents]
    y = np.array(labels, dtype=np.int64)
    if len(np.unique(y)) < 2:
        return np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION))
    output, bias = np.zeros((DIMENSION, 2)), np.zeros(2)
    steps, step = EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            batch = order[k : k + BATCH]
            size = [len(features[i][0]) for i in batch]
            bucket = np.concatenate([features[i][0] for i in batch])
            weight = np.concatenate([features[i][1] for i in batch])
            row = np.repeat(np.arange(len(batch)), size)
            hidden = np.stack([np.bincount(row, weights=weight * vectors[bucket, d], minlength=len(batch)) for d in range(DIMENSION)], axis=1)
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = p @ output.T
            output -= rate / len(batch) * hidden.T @ p
            bias -= rate / len(batch) * p.sum(axis=0)
            np.add.at(vectors, bucket, -rate * weight[:, None] * back[row])
    gap = output[:, 1] - output[:, 0]
    return vectors @ gap, float(bias[1] - bias[0])


def scorer(model: tuple[np.ndarray, float]) -> Callable[[str], float]:
    values, bias = model[0].tolist(), model[1]

    def value(word: str) -> float:
        ids = parts(word)
        return sum(values[i] for i in ids) / len(ids)

    known = Remembered(value)
    repeat = value(REPEAT)

    def score(text: str) -> float:
        words, repeats = tokens(text)
        total = sum(map(known.__getitem__, words)) + repeats * repeat
        known.age()
        z = bias + total / max(len(words) + repeats, 1)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    held = fold(FOLDS) == HELD_OUT
    model = train(*labelled_sample(docs, labels, "quality", ~held, sample))
    give_back()
    return scored(docs, scorer, model, held, THRESHOLD)
