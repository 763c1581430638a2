"""Graded quality by ordinal regression with a cumulative logit link.

One weight vector over hashed text features is shared by all grades, and ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the tail probability P(grade >= k) follow.
Features are means over a text's words: the word, its shape (upper, lower, digit runs and marks) and whether it
repeats the word before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick

DIM = 1 << 14
MAX_ROWS = 4000  # labelled rows the fit reads at most, chosen by a hash of doc_id
CACHE_WORDS = 100_000
KEEP_TAIL = 0.35  # least probability of the upper grades at which a document stays
REPEAT = 0


def shape(word: str) -> str:
    out = "".join("u" if c.isupper() else "l" if c.isalpha() else "0" if c.isdigit() else c for c in word[:40])
    return re.sub(r"(.)\1+", r"\1+", out)


def features(word: str) -> tuple[int, int]:
    return 1 + zlib.crc32(word.lower().encode()) % (DIM - 1), 1 + zlib.crc32(b"\0" + shape(word).encode()) % (DIM - 1)


@dataclass
class Ordinal:
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds
    grades: np.ndarray  # the values the grades stand for, ascending

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= grades[k]) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - np.asarray(z)[:, None], -50, 50)))

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades)


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, rounds: int = 200, rate: float = 1.0, l2: float = 1e-5) -> Ordinal:
    """Maximum likelihood by adaptive gradient steps; the gaps of the thresholds are exponentials, so they stay ordered."""
    grades, y = np.unique(grade, return_inverse=True)
    n, k = len(y), len(grades)
    w, gaps = np.zeros(DIM), np.zeros(k - 1)
    if k > 1:
        share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / n, 0.01, 0.99)
        first = np.log(share / (1 - share))
        gaps[0], gaps[1:] = first[0], np.log(np.maximum(np.diff(first), 0.05))
    sum_w, sum_g = np.full(DIM, 1e-8), np.full(k - 1, 1e-8)
    for _ in range(rounds if k > 1 else 0):
        cuts = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])])
        z = np.bincount(rows, vals * w[cols], n)
        s = 1 / (1 + np.exp(-np.clip(np.r_[-np.inf, cuts, np.inf][None, :] - z[:, None], -40, 40)))
        s[:, 0], s[:, -1] = 0, 1
        hi, lo = s[np.arange(n), y + 1], s[np.arange(n), y]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gz = (dhi - dlo) / n  # of the negative log-likelihood by z
        gw = np.bincount(cols, vals * gz[rows], DIM) + l2 * w
        gc = np.bincount(y, -dhi / n, k)[:-1] + np.bincount(y, dlo / n, k)[1:]
        gg = np.cumsum(gc[::-1])[::-1] * np.r_[1, np.exp(gaps[1:])]
        sum_w += gw * gw
        sum_g += gg * gg
        w -= rate * gw / np.sqrt(sum_w)
        gaps -= 0.1 * gg / np.sqrt(sum_g)
    cuts = np.cumsum(np.r_[gaps[0], np.exp(gaps[1:])]) if k > 1 else np.zeros(0)
    return Ordinal(w, cuts, grades.astype(float))


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, vals = [], []
            for t in b.column(0):
                words = (t.as_py() or "").split()
                ids = np.array([f for w in words for f in features(w)] + [REPEAT] * sum(map(eq, words, words[1:])), np.int64)
                c, n = np.unique(ids, return_counts=True)
                cols.append(c)
                vals.append(n / max(1, len(words)))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["grade", "cols", "vals"])

    return docs.select("text", "grade").mapInArrow(run, "grade double, cols array<int>, vals array<float>")


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_rows: int = MAX_ROWS) -> Ordinal | None:
    """Fits on at most max_rows labelled documents; None if there are none. Null grades and ids are left out."""
    some = pick(labels, "doc_id", grade).select("doc_id", F.col(grade).cast("double").alias("grade")).dropna().orderBy(F.xxhash64("doc_id"), "grade").limit(max_rows)
    found = _vectors(pick(docs, "doc_id", "text").join(F.broadcast(some), "doc_id")).toArrow()
    if not found.num_rows:
        return None
    cols, vals = found.column("cols").combine_chunks(), found.column("vals").combine_chunks()
    rows = np.repeat(np.arange(found.num_rows), np.diff(cols.offsets.to_numpy()))
    return fit(rows, cols.flatten().to_numpy(), vals.flatten().to_numpy().astype(float), found.column("grade").to_numpy())


class _Weights(dict):
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word: str) -> float:
        a, b = features(word)
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = x = float(self.weights[a] + self.weights[b])
        return x


def score(docs: DataFrame, model: Ordinal | None, keep_tail: float = KEEP_TAIL) -> DataFrame:
    """(doc_id, expected_grade, tail_prob, keep) for every row; tail_prob is P(a grade above the lowest).

    Null and empty texts have score 0. Repeated rows get a row each. Without a model the grades are null and all stay.
    """
    kind = dict(docs.dtypes)["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known = _Weights(m.weights) if m else None
        for b in batches:
            z = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(1)):
                words = (t.as_py() or "").split()
                if m and words:
                    z[i] = (sum(map(known.__getitem__, words)) + m.weights[REPEAT] * sum(map(eq, words, words[1:]))) / len(words)
            if m:
                tail = m.tails(z)[:, 0] if len(m.cuts) else np.ones(len(z))
                out = [pa.array(m.expected(z)), pa.array(tail), pa.array(tail >= keep_tail)]
            else:
                out = [pa.nulls(len(z), pa.float64())] * 2 + [pa.array(np.ones(len(z), bool))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["doc_id", "expected_grade", "tail_prob", "keep"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double, keep boolean")
