"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own text and of its neighbours' texts; a chain with two states (bad, good) links
neighbouring lines. Forward-backward gives each line's marginal; their mean, weighted by line length, is the
document's raw quality, and a logistic fit on the training documents turns it into a probability.

Training: document labels are given to all lines of a bounded sample of labelled rows (MAX_TRAIN documents, those
with the smallest hash of doc_id) and the chain's likelihood is maximised by gradient steps on the driver.
Scoring works batch by batch and keeps nothing between documents. Inputs are texts alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled sample, and of the lines of each that are learned from.
MAX_TRAIN = 4000
STEPS, RATE, DECAY = 250, 0.08, 1e-4
THRESHOLD = 0.7
SYMBOLS, MARKS, UPPER, DIGITS = b"#*$%&<>", b"!?", bytes(range(65, 91)), b"0123456789"
OWN = 12
#: Own features, those of the previous and next line, first and last line, and a constant.
WIDTH = 3 * OWN + 3


def line_features(line: bytes) -> tuple:
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return (0.0,) * (OWN - 1) + (1.0,)
    share = lambda drop: (size - len(line.translate(None, drop))) / size
    distinct = len(set(words))
    pipes = line.count(b"|")
    return (
        min(1.0, 5 * share(SYMBOLS)), min(1.0, 4 * share(MARKS)), min(1.0, 2 * share(UPPER)), min(1.0, 4 * share(DIGITS)),
        min(1.0, 4 * pipes / n), float(pipes > 0), 1 - distinct / n, sum(map(eq, words, words[1:])) / n,
        min(2.0, size / n / 10), min(1.0, n / 40), float(line.rstrip()[-1:] in (b".", b"?")), 0.0,
    )


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, their lengths, lines by document); a null or empty text is one empty line."""
    rows, lengths, counts = [], [], []
    for text in texts:
        lines = (text or b"").split(b"\n")
        rows.extend(map(line_features, lines))
        lengths.extend(map(len, lines))
        counts.append(len(lines))
    own = np.array(rows, np.float64).reshape(-1, OWN)
    count = np.array(counts, np.int64)
    first = np.cumsum(count) - count
    x = np.zeros((len(own), WIDTH))
    x[:, :OWN] = own
    x[1:, OWN : 2 * OWN] = own[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:]
    last = first + count - 1
    x[first, OWN : 2 * OWN] = 0
    x[last, 2 * OWN : 3 * OWN] = 0
    x[first, -3] = x[last, -2] = x[:, -1] = 1
    return x, np.array(lengths, np.float64), count


def marginals(unary: np.ndarray, count: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance that each line is good, expected transitions of each document as a sum 2 x 2).

    unary: log-odds for good. Documents step together, longest first, so the shorter ones drop out.
    """
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    begin, size = first[order], count[order]
    steps = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
    forward, backward = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    score = np.stack([np.zeros(len(unary)), unary], axis=1)
    for t, n in enumerate(left):
        i = begin[:n] + t
        if t:
            a = forward[i - 1][:, :, None] + pair[None]
            forward[i] = np.logaddexp(a[:, 0], a[:, 1]) + score[i]
        else:
            forward[i] = score[i]
        forward[i] -= forward[i].max(axis=1, keepdims=True)
    moves = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        i = begin[: left[t + 1]] + t
        b = pair[None] + (score[i + 1] + backward[i + 1])[:, None, :]
        backward[i] = np.logaddexp(b[:, :, 0], b[:, :, 1])
        both = forward[i][:, :, None] + b
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        moves += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[i] -= backward[i].max(axis=1, keepdims=True)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), moves


@dataclass
class Chain:
    """Weights of the lines' features, of transitions, and of the last logistic step."""

    weights: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    base: float = 0.0

    def raw(self, texts: list[bytes | None]) -> np.ndarray:
        """Log-odds of the length-weighted mean marginal."""
        x, length, count = features(texts)
        good, _ = marginals(x @ self.weights, count, self.pair)
        owner = np.repeat(np.arange(len(count)), count)
        weight = length + 1  # the line's end counts, so an empty text has a weight
        q = np.bincount(owner, good * weight, len(count)) / np.bincount(owner, weight, len(count))
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.log(q / (1 - q))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.base, -60, 60))) if texts else np.zeros(0)


def train(texts: list[bytes | None], labels: list[int]) -> Chain:
    """Fits a chain; without both labels there is nothing to learn and every score is the share of ones."""
    y = np.array(labels, np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
        return Chain(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log(p / (1 - p))))
    x, _, count = features(texts)
    owner = np.repeat(np.arange(len(count)), count)
    line_y = y[owner]
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_y[inner].astype(int), line_y[inner + 1].astype(int)), 1)
    theta = np.zeros(WIDTH + 4)
    mean, var = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, moves = marginals(x @ theta[:WIDTH], count, theta[WIDTH:].reshape(2, 2))
        slope = np.concatenate([x.T @ (line_y - good), (seen - moves).ravel()]) / len(x) - DECAY * theta
        mean, var = 0.9 * mean + 0.1 * slope, 0.99 * var + 0.01 * slope**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
    chain = Chain(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
    raw = chain.raw(texts)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        h = np.array([[np.sum(w * raw * raw) + 1e-2, np.sum(w * raw)], [np.sum(w * raw), np.sum(w) + 1e-2]])
        da, db = np.linalg.solve(h, [np.sum((y - p) * raw) - 1e-2 * (a - 1), np.sum(y - p)])
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -1, 1)
    return Chain(chain.weights, chain.pair, float(max(a, 0.05)), float(b))


def held_out(doc_id: str = "doc_id"):
    """True for rows whose labels are not learned from; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Chain:
    """Trains on at most bound labelled rows that are not held out. A doc_id with several labels: the smallest."""
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
        .where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    # the sample is bounded, so its side may be broadcast
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    sample = rows.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text")
    got = sample.dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return train([bytes(r["text"]) if r["text"] is not None else None for r in got], [r["quality"] for r in got])


def score_column(chain: Chain, text: str = "text"):
    """The chance of good quality for each text."""

    @F.pandas_udf("double")
    def udf(texts: pd.Series) -> pd.Series:
        rows, out = texts.tolist(), []
        for k in range(0, len(rows), 512):
            out.append(chain.score(rows[k : k + 512]))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return udf(F.col(text).cast("string").cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted). Null and empty texts are one empty line; null ids are held out."""
    chain = fit(docs, labels, bound)
    out = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), score_column(chain).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
