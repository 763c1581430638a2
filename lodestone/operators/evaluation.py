"""Rank metrics, comparisons and fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def query_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """results (query_id, rank, item), gold (query_id, n_gold) with results.hit set: reciprocal rank, hits, recall and binary nDCG@10."""
    gain = F.when(F.col("hit") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    per = results.groupBy("query_id").agg(
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"),
        *[F.count_if(F.col("hit") & (F.col("rank") <= k)).alias(f"n{k}") for k in (3, 8)],
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = per.join(gold.where("n_gold > 0"), "query_id")
    hit = lambda k: F.coalesce((F.col("first") <= k).cast("long"), F.lit(0))
    return rows.select(
        "query_id", F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), *[hit(k).alias(f"hit{k}") for k in (1, 3, 8)],
        *[F.round(F.col(f"n{k}") / F.col("n_gold"), 6).alias(f"recall{k}") for k in (3, 8)], F.round(F.col("dcg") / ideal, 6).alias("ndcg10"),
    )


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, d = k / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.round(mid - half, 6), F.round(mid + half, 6)


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tau, n) over the items that two short ranked lists (item, rank) share; null under two."""
    both = a.select("item", F.col("rank").alias("x")).join(b.select("item", F.col("rank").alias("y")), "item")
    i, j = both.select(F.col("x").alias("x1"), F.col("y").alias("y1")), both.select(F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = i.join(j, F.col("x1") < F.col("x2")).agg(F.sum(F.signum((F.col("y2") - F.col("y1")).cast("double"))).alias("s"), F.count("*").alias("n"))
    return pairs.select(F.round(F.when(F.col("n") > 0, F.col("s") / F.col("n")), 6).alias("tau"), "n")


def prior_fit(trials: DataFrame, guess: float, m: float) -> DataFrame:
    """(type, map, prior): smoothed hit rates, types without a hit left out, scaled by the best of the type."""
    rows = trials.groupBy("type", "map").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    w = Window.partitionBy("type")
    raw = rows.withColumn("raw", (F.col("k") + m * guess) / (F.col("n") + m)).withColumn("top", F.max("raw").over(w)).withColumn("any", F.sum("k").over(w))
    return raw.where("any > 0").select("type", "map", F.round(F.col("raw") / F.col("top"), 6).alias("prior"))


class SplitMix:
    """SplitMix64."""

    def __init__(self, seed: int):
        self.state = seed & (1 << 64) - 1

    def next(self) -> int:
        mask = (1 << 64) - 1
        self.state = self.state + 0x9E3779B97F4A7C15 & mask
        z = self.state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    def below(self, n: int) -> int:
        return self.next() % n


def bootstrap(deltas: DataFrame, resamples: int = 1000, seed: int = 7) -> DataFrame:
    """(tag, mean, low, high) of paired differences (tag, delta): a tag's differences are a query set, held by one task."""

    def run(pdf):
        import pandas as pd

        x, rng = np.sort(pdf["delta"].to_numpy()), SplitMix(seed)
        means = np.sort([np.mean([x[rng.below(len(x))] for _ in range(len(x))]) for _ in range(resamples)])
        return pd.DataFrame({"tag": [pdf["tag"].iloc[0]], "mean": [x.mean()], "low": [means[resamples * 25 // 1000]], "high": [means[resamples * 975 // 1000 - 1]]})

    return deltas.groupBy("tag").applyInPandas(run, "tag string, mean double, low double, high double")


def in_hold_out(key: Column, percent: int, salt: str = "") -> Column:
    """First eight bytes of the SHA-256 of the salted id, modulo 100, below the percentage."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), key), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(100)).cast("int") < percent
