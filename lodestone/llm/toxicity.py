"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give every expression (a lower-cased word) a probability: its count of
documents in the class less a discount, which grows with the count and follows from how many words have each count
(modified Kneser-Ney), plus the discounted mass dealt by the counts that both classes share. So a rare expression leans on the shared
counts, where both classes agree, and only what a class holds beyond its share tells. A document's evidence is
the length-normalised difference of its two log-likelihoods, and the sum and the greatest of its telling differences; a
logistic map, fitted with each document's own counts left out, turns it into a score from 0 to 1.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.llm.common import BROADCAST_BYTES, checked, pick, stash

NOVEL = 0.05  # documents that the shared counts allow a word besides those counted
LOCAL_ROWS = 1 << 20  # words that a task looks up itself, the commonest first; the others are joined
CALIBRATION_ROWS = 4000  # labelled rows that the logistic map is fitted on, chosen by a hash of doc_id
EMIT_WORDS = 300_000
_WORD = re.compile(r"\w+")
CUT = 3.0  # log-likelihood difference from which a word counts as telling
THRESHOLD = 0.7


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    words: dict[str, tuple[int, int]]  # documents of (toxic, ordinary) text that hold the word; of the calibration rows' words
    docs: tuple[int, int]  # sums of the words' counts
    discounts: tuple[list[float], list[float]]  # of each class, for counts of 0, 1, 2 and more
    spare: tuple[float, float]  # share of each class that the discounts leave to the shared counts
    map: np.ndarray | None = None  # the logistic map
    table: DataFrame | None = None  # (word, seen, ratio) of all training words
    rows: int = 0  # of the table

    def ratio(self, word: str, own: int | None = None) -> float:
        """ln P(word | toxic) - ln P(word | ordinary); own: the class of a document with the word whose counts are left out."""
        n = list(self.words.get(word, (0, 0)))
        if own is not None and n[own]:
            n[own] -= 1
        return self.of_counts(n[0], n[1])

    def of_counts(self, n0: int, n1: int) -> float:
        shared = (n0 + n1 + NOVEL) / max(1, sum(self.docs))
        p = [(n - d[min(n, 3)]) / max(1, docs) + spare * shared for n, d, docs, spare in zip((n0, n1), self.discounts, self.docs, self.spare, strict=True)]
        return float(np.log(p[0] / p[1]))


def discounts_of(kinds: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and more, from the number of words with a count of 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (max(1, x) for x in kinds)
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(float(np.clip(k - (k + 1) * y * above / at, 0.1 * k, 0.95 * k)) for k, at, above in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]


def evidence(ratios: list[float]) -> tuple[float, float, float]:
    """Features of a text: the mean difference, the greatest, and the logarithm of the sum of telling ones."""
    if not ratios:
        return 0.0, 0.0, 0.0
    return sum(ratios) / len(ratios), max(0.0, max(ratios)), np.log1p(sum(x for x in ratios if x > CUT))


def _counts(train: DataFrame) -> DataFrame:
    """(word, n0, n1): documents of toxic and ordinary text with the word, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            r = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([h[k] for k in keys], pa.int64()) for h in held)], ["word", "n0", "n1"])
            for h in held:
                h.clear()
            return r

        for b in batches:
            for t, toxic in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                held[0 if toxic else 1].update(set(words_of(t.as_py())))
                if len(held[0]) + len(held[1]) > EMIT_WORDS:
                    yield out()
        yield out()

    return train.select("text", "toxic").mapInArrow(run, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """labelled: (doc_id, text, toxic boolean). Counts come from all of it; only the logistic map reads a bounded sample."""
    counts = stash(_counts(labelled))
    sums = counts.agg(
        *[F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"docs{c}") for c in (0, 1)],
        *[F.count(F.when(F.col(f"n{c}") == k, 1)).alias(f"k{c}{k}") for c in (0, 1) for k in (1, 2, 3, 4)],
        *[F.count(F.when(F.col(f"n{c}") > 2, 1)).alias(f"more{c}") for c in (0, 1)],
    ).first()
    docs = (sums["docs0"], sums["docs1"])
    discounts = tuple(discounts_of([sums[f"k{c}{k}"] for k in (1, 2, 3, 4)]) for c in (0, 1))
    left = [d[1] * sums[f"k{c}1"] + d[2] * sums[f"k{c}2"] + d[3] * sums[f"more{c}"] for c, d in enumerate(discounts)]
    spare = tuple(x / n if n else 1.0 for x, n in zip(left, docs, strict=True))
    chosen = stash(_calibration(labelled, calibration_rows))
    near = stash(chosen.select("text").mapInArrow(_distinct, "word string").distinct())
    words = counts.join(checked(near), "word", "left_semi").toArrow().to_pydict()
    model = Model(dict(zip(words["word"], zip(words["n0"], words["n1"], strict=True), strict=True)), docs, discounts, spare)
    model.map = _fit_map(chosen, model)
    bare = Model({}, docs, discounts, spare)

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], float] = {}
        for b in batches:
            pairs = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            known.update({p: bare.of_counts(*p) for p in set(pairs).difference(known)})
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x + y for x, y in pairs], pa.int64()), pa.array([known[p] for p in pairs], pa.float64())], ["word", "seen", "ratio"])

    model.table = stash(counts.select("word", "n0", "n1").mapInArrow(ratios, "word string, seen long, ratio double"))
    model.rows = model.table.count()
    return model


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array({w for t in b.column(0) for w in words_of(t.as_py())}, pa.string())], ["word"])


def _calibration(labelled: DataFrame, most: int) -> DataFrame:
    """As many rows of either class as half the bound, by a hash of doc_id."""
    some = [labelled.where(c).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for c in ("toxic", "not toxic")]
    return labelled.join(F.broadcast(some[0].unionByName(some[1]).distinct()), "doc_id").select("text", "toxic")


def _fit_map(chosen: DataFrame, model: Model) -> np.ndarray:
    sent = chosen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            toxic = b.column(1).to_pylist()
            f = [evidence([m.ratio(w, 0 if y else 1) for w in words_of(t.as_py())]) for t, y in zip(b.column(0), toxic, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "toxic"])

    got = chosen.select("text", "toxic").mapInArrow(run, "f array<double>, toxic boolean").toArrow()
    if not got.num_rows:
        return np.array([-3.0, 0, 0, 0])
    x = np.c_[np.ones(got.num_rows), np.array(got.column("f").to_pylist())]
    y = got.column("toxic").to_numpy().astype(float)
    return logistic_map(x, y)


def logistic_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (column 0 of x is one); classes weigh alike, and evidence never counts against toxicity."""
    scale = np.maximum(np.abs(x).max(0), 1e-9)
    x, share = x / scale, np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    use = np.ones(x.shape[1], bool)
    while True:
        z, w = x[:, use], np.zeros(use.sum())
        ridge = 1e-2 * np.eye(len(w))
        for _ in range(40):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (weight * (y - p)) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        full = np.zeros(x.shape[1])
        full[use] = w
        against = (full < 0) & (np.arange(len(full)) > 0)
        if not against.any():
            return full / scale
        use[against] = False


def _logistic(f: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(doc_id, score, predicted) for every row, by its text alone. Null and empty texts get the map's value for no evidence.

    Tasks look up the commonest words themselves. If the tables hold more than local_rows, the other distinct words of each
    document are joined with them, so local_rows changes no result.
    """
    kind = dict(docs.dtypes)["doc_id"]
    default = model.of_counts(0, 0)
    t = model.table.orderBy(F.desc("seen"), "word").limit(local_rows).select("word", "ratio").toArrow()
    whole, weights = model.rows <= local_rows, model.map
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for b in batches:
            f = np.array([(1.0, *evidence([words.get(w, default) for w in words_of(t.as_py())])) for t in b.column(1)]).reshape(-1, 4)
            p = _logistic(f, weights)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    if whole:
        return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row one entry without a word, with the sums over words known here, and one for each other distinct word."""
        words = sent.value
        for b in batches:
            out = []
            for row, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                counts = Counter(words_of(t.as_py()))
                here = [(words[w], n) for w, n in counts.items() if w in words]
                out.append((row, d, None, sum(n for _, n in here), sum(x * n for x, n in here), max((x for x, _ in here), default=0.0), sum(x * n for x, n in here if x > CUT)))
                out += [(row, d, w, n, 0.0, 0.0, 0.0) for w, n in counts.items() if w not in words]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)

    names = ["row", "doc_id", "word", "n", "total", "most", "telling"]
    id_type = to_arrow_type(docs.select("doc_id").schema[0].dataType)
    kinds = [pa.int64(), id_type, pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    rows = pick(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    dealt = stash(rows.mapInArrow(deal, f"row long, doc_id {kind}, word string, n long, total double, most double, telling double"))
    # each distinct word is looked up once; a null word has no ratio
    asked = dealt.where("word is not null").select("word").distinct()
    found = asked.join(model.table.select(F.col("word").alias("key"), "ratio"), F.col("word") == F.col("key"), "left")
    found = stash(found.select(F.col("word").alias("asked"), F.coalesce("ratio", F.lit(default)).alias("ratio")))
    x = F.col("ratio")
    met = dealt.join(checked(found), F.col("word") == F.col("asked"), "left").groupBy("row", "doc_id").agg(
        F.sum("n").alias("n"), F.sum(F.coalesce(x * F.col("n"), "total")).alias("total"), F.max(F.greatest(F.coalesce(x, "most"), F.lit(0.0))).alias("most"),
        F.sum(F.when(x > CUT, x * F.col("n")).otherwise(F.col("telling"))).alias("telling"),
    )
    parts = [F.lit(1.0), F.col("total") / F.greatest("n", F.lit(1)), F.col("most"), F.log1p("telling")]
    z = sum((f * float(w) for f, w in zip(parts, weights, strict=True)), F.lit(0.0))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return met.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def labelled(docs: DataFrame, labels: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Training rows: documents with a label whose crc32 leaves 0 or 2. Rows with null ids or labels take no part; a
    document with several labels is toxic if one says so."""
    marks = pick(labels, "doc_id", "toxic").dropna().where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int") > 0).alias("toxic"))
    return pick(docs, "doc_id", "text").join(checked(stash(marks), limit), "doc_id")
