"""Toxicity scores from FTRL-proximal logistic regression.

Features are the hashed word n-grams (one and two words) and skip-grams (two words
with one or two others between them) that a text has, each counted once.  FTRL-proximal keeps a learning
rate per coordinate, and its L1 term leaves all but a few of the weights at zero, so
the model is a short list of (coordinate, weight) pairs: at most ``2 ** BITS`` of them.

Training reads a bounded, hash-ordered sample of the labelled rows in one task.
Scoring reads every text in place; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_slices

BITS = 20
#: Labelled rows that the classifier is fitted on at most, half of them of either label where there are as many.
SAMPLE_ROWS = 6_000
EPOCHS = 6
#: A coordinate is learned if so many rows of the sample have it.
MIN_ROWS = 5
#: The distances between the two words of a pair: 1 is a bigram, 2 and 3 are skip-grams.
DISTANCES = (1, 2, 3)

_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Texts to coordinates; remembers the hashes of up to a million words."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def words(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        found = _WORDS.findall(text.lower())
        for w in found:
            if w not in known:
                known[w] = zlib.crc32(w.encode())
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def features(self, text: str | None) -> np.ndarray:
        """The distinct coordinates of a text, in order."""
        if not text:
            return np.empty(0, np.int64)
        w = self.words(text)
        shift = np.uint64(64 - BITS)
        parts = [w * _MIX >> shift]
        for d in DISTANCES:
            if len(w) > d:
                pair = (w[:-d] * np.uint64(0xBF58476D1CE4E5B9)) ^ (w[d:] + np.uint64(d)) * np.uint64(0x94D049BB133111EB)
                parts.append((pair ^ pair >> np.uint64(31)) * _MIX >> shift)
        return np.unique(np.concatenate(parts)).astype(np.int64)


@dataclass
class Ftrl:
    """FTRL-proximal over binary features.

    A coordinate's gradients add up over all rows, so the L1 bar that chance does not reach
    grows with the rows: ``l1_per_row`` of them, between ``l1_least`` and ``l1_most``.
    """

    alpha: float = 0.5
    beta: float = 1.0
    l2: float = 1.0
    l1_per_row: float = 0.004
    l1_least: float = 3.0
    l1_most: float = 20.0

    def fit(self, rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
        """(coordinates, weights, bias); the bias is learned without L1."""
        counts = np.bincount(np.concatenate(rows), minlength=1 << BITS)
        rows = [x[counts[x] >= MIN_ROWS] for x in rows]
        self.l1 = min(self.l1_most, max(self.l1_least, self.l1_per_row * len(rows)))
        z = np.zeros(1 << BITS)
        n = np.zeros(1 << BITS)
        bias_z = bias_n = bias = 0.0
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                x, y = rows[i], labels[i]
                w = self._weights(z[x], n[x])
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum())))))
                g = p - y
                root = np.sqrt(n[x])
                new = np.sqrt(n[x] + g * g)
                z[x] += g - (new - root) / self.alpha * w
                n[x] += g * g
                sigma = (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / self.alpha
                bias_z += g - sigma * bias
                bias_n += g * g
                bias = -bias_z / ((self.beta + math.sqrt(bias_n)) / self.alpha)
        at = np.flatnonzero(np.abs(z) > self.l1)
        return at, self._weights(z[at], n[at]), bias

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample_rows: int = SAMPLE_ROWS
) -> list[tuple[int, float]]:
    """[(coordinate, weight)] with the bias under coordinate -1.

    Fits on the documents of at most ``sample_rows`` ids of ``labels``, the first in the order of their
    hashes, half of each label, and at most as many rows, whatever ids are repeated.  The ids are chosen before any text is read
    and go to every executor; only the texts chosen move.  An id with several labels has the greatest.  Rows with NULL id or label are
    left out.  Without rows: just a bias of -2.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"))
    half = sample_rows // 2
    one, zero = (rows.where(F.col("_y") == v).orderBy(F.xxhash64("_id"), "_id").limit(half) for v in (1, 0))
    chosen = F.broadcast(one.unionByName(zero))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").select("_text", "_y")
    texts = texts.orderBy(F.xxhash64("_text"), "_text", "_y").limit(sample_rows)

    def fit(batches):
        import pyarrow as pa

        hasher = Hasher()
        found = sorted((t or "", y) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        x, y = [hasher.features(t) for t, _ in found], [y for _, y in found]
        at, weights, bias = Ftrl().fit(x, y) if x else (np.empty(0), np.empty(0), -2.0)
        at, weights = np.append(at, -1).astype(np.int64), np.append(weights, bias)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights)], names=["at", "weight"])

    fitted = texts.repartition(1).mapInArrow(fit, "at bigint, weight double")
    return [(r.at, r.weight) for r in fitted.collect()] or [(-1, -2.0)]


def score(docs: DataFrame, model: list[tuple[int, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (id, score, predicted).

    The score is the model's probability of a toxic text; NULL and empty texts have the
    score of the bias.  Repeated rows are scored one by one; other columns are not read.
    """
    weights = {a: w for a, w in model if a >= 0}
    bias = sum(w for a, w in model if a < 0)

    def setup():
        dense = np.zeros(1 << BITS)
        dense[list(weights)] = list(weights.values())
        return Hasher(), dense

    def work(idents, texts, state):
        hasher, dense = state
        total = [bias + float(dense[hasher.features(t)].sum()) for t in texts]
        p = [1 / (1 + math.exp(-max(-35.0, min(35.0, t)))) for t in total]
        return idents, p, [int(x >= 0.5) for x in p]

    return map_slices(docs.select(F.col(id_col).cast("bigint"), text_col), work, "id bigint, score double, predicted int", setup)
