"""Quality by a generalised additive model with pairwise interactions.

Features of the whole text are binned at quantiles. Boosting goes through the features in turn; each step fits a shallow
tree on one feature's bins and adds its leaves to that feature's lookup table. Then the pairs of features that explain
most of what is left get coarse two-dimensional tables in the same way. A score is a sum of table entries.

Training takes about NEGATIVES and POSITIVES labelled rows (by hash of their ids) to one task; the share of labels is
restored by weights. The tables are a few kilobytes and are broadcast. Null and empty texts have the features of a text
without words. Without labelled rows of both kinds the score is 0. The cut between the labels lies at a score of 0.3.
Repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import itertools

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum_spark.llm.learning import counts_of, fitted, logit, remainder, sample, sigmoid
from quorum_spark.operators.scratch import arrow_rows
from quorum_spark.llm.words import LINES, LOWER, Words, pieces

if TYPE_CHECKING:
    import pandas as pd

NEGATIVES, POSITIVES = 3000, 3000
THRESHOLD = 0.3
BINS, COARSE, CYCLES, PAIRS, PAIR_CYCLES, RATE, LEAVES = 32, 8, 80, 6, 30, 0.15, 4

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 0 if _c >= 128 else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 4 if _s in ".,;:'\"" else 5 if _s in "!?" else 6 if _s.isspace() else 7
NAMES = ["log_words", "word_length", "upper", "digit", "stop", "shout", "space", "symbol", "distinct", "commonest", "lines", "same_lines", "marked_words"]


def features(arr: pa.Array) -> np.ndarray:
    """A row of numbers for each text, in the order of NAMES."""
    w = Words(arr, lower=False)
    n = len(w)
    size = np.maximum(np.diff(w.off), 1)
    doc = np.repeat(np.arange(n), np.diff(w.off))
    kinds = np.bincount(doc * 8 + _CLASS[w.buf], minlength=8 * n).reshape(n, 8) / size[:, None]
    count = np.diff(w.at)
    some = np.maximum(count, 1)
    lens = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
    marked = np.concatenate([[0], np.cumsum(np.isin(_CLASS[w.buf[w.ends - 1]], (5, 7)))]) if len(w.ends) else np.zeros(1)
    w.buf = LOWER[w.buf]
    h = w.hashes()
    lines = Words(arr, spaces=LINES)
    hl = lines.hashes()
    distinct, top, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        if count[i]:
            s = np.sort(h[w.at[i] : w.at[i + 1]])
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
        own = hl[lines.at[i] : lines.at[i + 1]]
        same[i] = len(own) - len(set(own.tolist()))
    n_lines = np.diff(lines.at)
    cols = [np.log1p(count), np.diff(lens[w.at]) / some, kinds[:, 2], kinds[:, 3], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 7], distinct / some, top / some, n_lines / some, same / np.maximum(n_lines, 1), np.diff(marked[w.at]) / some]
    return np.stack(cols, 1)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over ordered bins, split up to LEAVES times where the gain is largest."""
    cuts = [(0, len(g))]
    gain_of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    while len(cuts) < LEAVES:
        best = max(((gain_of(a, k) + gain_of(k, b) - gain_of(a, b), a, k, b) for a, b in cuts for k in range(a + 1, b)), default=(0, 0, 0, 0))
        if best[0] <= 1e-6:
            break
        _, a, k, b = best
        cuts.remove((a, b))
        cuts += [(a, k), (k, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.bins(x)
        self.base = logit(float((weight * y).sum() / weight.sum()))
        self.tables = [np.zeros(BINS) for _ in NAMES]
        z = np.full(len(y), self.base)
        for _, f in itertools.product(range(CYCLES), range(len(NAMES))):
            p = sigmoid(z)
            step = RATE * _tree(np.bincount(b[:, f], weight * (y - p), BINS), np.bincount(b[:, f], weight * p * (1 - p), BINS))
            self.tables[f] += step
            z += step[b[:, f]]
        p, c = sigmoid(z), b * COARSE // BINS
        g, h = weight * (y - p), weight * p * (1 - p)

        def left(pair):
            cell = c[:, pair[0]] * COARSE + c[:, pair[1]]
            return (np.bincount(cell, g, COARSE**2) ** 2 / (np.bincount(cell, h, COARSE**2) + 1)).sum()

        self.pairs = sorted(itertools.combinations(range(len(NAMES)), 2), key=left, reverse=True)[:PAIRS]
        self.grids = [np.zeros(COARSE**2) for _ in self.pairs]
        for _, k in itertools.product(range(PAIR_CYCLES), range(PAIRS)):
            cell = c[:, self.pairs[k][0]] * COARSE + c[:, self.pairs[k][1]]
            p = sigmoid(z)
            step = RATE * np.bincount(cell, weight * (y - p), COARSE**2) / (np.bincount(cell, weight * p * (1 - p), COARSE**2) + 5)
            self.grids[k] += step
            z += step[cell]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        c = b * COARSE // BINS
        z = self.base + sum(t[b[:, f]] for f, t in enumerate(self.tables)) + sum(g[c[:, i] * COARSE + c[:, j]] for g, (i, j) in zip(self.grids, self.pairs, strict=True))
        return sigmoid(z + logit(THRESHOLD))


def train(rows: pd.DataFrame, share: float) -> Model | None:
    """rows: text, quality. share: of label 1 among all labelled rows."""
    y = rows["quality"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.concatenate([features(pa.array(rows["text"].iloc[a : a + 256].tolist(), pa.string())) for a in range(0, len(rows), 256)])
    return Model(x, y, np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))


def _score(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                score = model.scores(features(part.column("text"))) if model else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.3). Learns outside the held-out fifth."""
    spark = docs.sparkSession
    arrow_rows(spark)
    texts = docs.select("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & (remainder("doc_id", 5) != 0))
    counts = counts_of(known, "quality")
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    rows = sample(known, texts, "quality", counts, {0: NEGATIVES, 1: POSITIVES})
    model = fitted(rows, lambda r: train(r, share), "doc_id", "quality")
    out = texts.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
