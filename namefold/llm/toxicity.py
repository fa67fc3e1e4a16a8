"""Toxicity by a factorization machine over hashed terms, learned by numpy stochastic gradient descent.

Terms are the distinct words of a text, lower-cased and bare of marks at their ends, and their prefixes of
four and five characters; a term that comes n times has the value 1 + ln n. Beside a weight for each term the machine has a vector for each, whose inner
products score pairs of terms, so that two terms together may mean what neither does alone.

Learns from at most ``sample`` labelled documents, never from held-out ones, over all buckets that at least
``LEAST`` of those documents have; there is no other choice of terms, so terms that mean something only together
have their vectors too. Buckets that alone tell the classes apart no better than chance learn at slower rates,
since many rare terms would otherwise remember single documents. Defined cases: null and empty texts have the score of the bias; without labels
of both kinds every score is 0.5; repeated rows each give a row; a null doc_id is not held out; very long texts are
scored whole; empty tables give no rows; other columns, whatever their names, are carried but not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from namefold.llm.learning import Remembered, fold, give_back, labelled_sample, scored

BUCKETS, FACTORS, EPOCHS, RATE, BATCH, DECAY = 1 << 22, 4, 15, 0.1, 32, 1e-3
#: Documents learned from, at most; a bucket is in so many of those documents at least.
SAMPLE, LEAST = 6000, 3
#: Words that the driver remembers while it learns.
TRAIN_WORDS = 20_000
#: Buckets whose chi-square is at most CHANCE * ln(number of buckets) learn weights and vectors at these parts of RATE.
CHANCE, SLOW_WEIGHT, SLOW_VECTOR = 2.0, 0.03, 0.2
#: Spread of the vectors at the start, and the squared gradients that each bucket starts with.
SPREAD, SEEN = 0.01, 1.0
#: A toxic document counts as often as clean ones outnumber it, up to this.
MOST_BALANCE = 8.0
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_"


def terms(word: str) -> tuple[int, ...]:
    """Hashed terms of a lower-cased token."""
    word = word.strip(MARKS)
    if not word:
        return ()
    forms = [b"w" + word.encode()] + [b"p" + word[:n].encode() for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(x) % BUCKETS for x in forms)


def train(documents: list[str], labels: list[int], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(buckets, weights, vectors, bias)."""
    known = Remembered(terms, TRAIN_WORDS)
    y = np.array(labels, dtype=np.float64)
    if len(np.unique(y)) < 2:
        return np.empty(0, dtype=np.int64), np.empty(0), np.empty((0, FACTORS)), 0.0
    found, values = [], []
    every, toxic = np.zeros(BUCKETS, dtype=np.int32), np.zeros(BUCKETS, dtype=np.int32)
    for text, label in zip(documents, labels, strict=True):
        ids, n = np.unique(np.fromiter(chain.from_iterable(map(known.__getitem__, text.lower().split())), dtype=np.int32), return_counts=True)
        known.age()
        every[ids] += 1
        toxic[ids] += label
        found.append(ids)
        values.append((1 + np.log(n)).astype(np.float32))
    del known
    share = y.mean()
    balance = min((1 - share) / share, MOST_BALANCE)
    bucket = np.flatnonzero(every >= LEAST)
    # Buckets that differ more from what the share of toxic documents would give than the most of so many would by chance.
    gain = (toxic[bucket] - every[bucket] * share) ** 2 / (every[bucket] * share * (1 - share))
    telling = gain > CHANCE * math.log(max(len(bucket), 1))
    rate_w, rate_v = np.where(telling, RATE, RATE * SLOW_WEIGHT), np.where(telling, RATE, RATE * SLOW_VECTOR)
    del every, toxic
    for k, ids in enumerate(found):  # document by document, so that little is held twice
        at = np.minimum(np.searchsorted(bucket, ids), max(len(bucket) - 1, 0))
        kept = bucket[at] == ids if len(bucket) else np.zeros(len(ids), dtype=bool)
        found[k], values[k] = at[kept].astype(np.int32), values[k][kept]
    edge = np.cumsum([0] + [len(ids) for ids in found])
    mine, value = np.concatenate(found), np.concatenate(values)
    del found, values
    rng = np.random.default_rng(seed)
    # One array for each factor, so that every step runs over plain arrays of a batch's terms.
    weight, vector, bias = np.zeros(len(bucket)), list(np.ascontiguousarray(rng.normal(0, SPREAD, (len(bucket), FACTORS)).T)), 0.0
    seen_w, seen_v, seen_b = np.full(len(bucket), SEEN), [np.full(len(bucket), SEEN) for _ in range(FACTORS)], 1e-8  # squared gradients so far
    here, place = np.zeros(len(bucket), dtype=bool), np.zeros(len(bucket), dtype=np.int32)

    def learn(parameter: np.ndarray, seen: np.ndarray, rate: np.ndarray, gradient: np.ndarray) -> None:
        """One step of a parameter at the batch's buckets ``near``, whose gradient is summed over its terms."""
        now = parameter[near]
        g = np.bincount(at_near, weights=gradient, minlength=len(near)) + DECAY * now
        past = seen[near] + g * g
        seen[near] = past
        parameter[near] = now - rate[near] * g / np.sqrt(past)

    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            batch = order[k : k + BATCH]
            ids = np.concatenate([mine[edge[i] : edge[i + 1]] for i in batch])
            x = np.concatenate([value[edge[i] : edge[i + 1]] for i in batch]).astype(np.float64)
            doc = np.repeat(np.arange(len(batch)), edge[batch + 1] - edge[batch])
            z = bias + np.bincount(doc, weights=weight[ids] * x, minlength=len(batch))
            parts = []
            for v in vector:
                vx = v[ids] * x
                total = np.bincount(doc, weights=vx, minlength=len(batch))
                z += (total * total - np.bincount(doc, weights=vx * vx, minlength=len(batch))) / 2
                parts.append(total[doc] - vx)
            off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * np.where(y[batch] == 1, balance, 1.0)
            here[ids] = True
            near = np.flatnonzero(here)
            place[near] = np.arange(len(near))
            at_near = place[ids]
            here[near] = False
            pull = off[doc] * x
            learn(weight, seen_w, rate_w, pull)
            for v, seen, part in zip(vector, seen_v, parts, strict=True):
                learn(v, seen, rate_v, pull * part)
            seen_b += off.sum() ** 2
            bias -= RATE * off.sum() / math.sqrt(seen_b)
    return bucket, weight, np.stack(vector, axis=1), bias


def scorer(model: tuple[np.ndarray, np.ndarray, np.ndarray, float]) -> Callable[[str], float]:
    buckets, weight, vector, bias = model
    number = {b: k for k, b in enumerate(buckets.tolist())}
    known = Remembered(lambda word: tuple(number[t] for t in terms(word) if t in number))

    def score(text: str) -> float:
        counts = Counter(chain.from_iterable(map(known.__getitem__, text.lower().split())))
        known.age()
        z = bias
        if counts:
            ids = np.fromiter(counts, dtype=np.int64)
            x = 1 + np.log(np.fromiter(counts.values(), dtype=np.float64))
            v = vector[ids] * x[:, None]
            total = v.sum(axis=0)
            z += float((weight[ids] * x).sum() + (total @ total - (v * v).sum()) / 2)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    held = fold(FOLDS) == HELD_OUT
    model = train(*labelled_sample(docs, labels, "toxic", ~held, sample))
    give_back()
    return scored(docs, scorer, model, held, THRESHOLD)


def reject(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``: those that ``classify`` predicts
    as 0. Rows are judged by their own text, so of rows with one doc_id some may go; the other cases are the module's."""
    held = fold(FOLDS) == HELD_OUT
    model = train(*labelled_sample(docs, labels, "toxic", ~held, sample))
    give_back()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        from namefold.llm.common import texts

        score = scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(x.decode("utf-8", "replace")) < threshold for x in texts(batch.column("text"))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


