"""Reports and their replay: pairing of runs, fusion under other settings, votes of a reranker, graded gains, lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.numbers import round_half


def pair_reports(base: DataFrame, cand: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, at, value) of two runs, the k-th of a key with the k-th: keys, k, base, cand. What has no partner stays, with null."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("at")).cast("long")
    a = base.withColumn("k", nth).select(*keys, "k", F.col("value").alias("base"))
    b = cand.withColumn("k", nth).select(*keys, "k", F.col("value").alias("cand"))
    return a.join(b, [*keys, "k"], "full_outer")


def refuse(pool: DataFrame, weights: dict[str, float], rrf_k: int, window: int, cap: int, vote: float | None = None) -> DataFrame:
    """Ranks a dumped pool (query, file, item, recorded, <channel>_rank..., rerank_rank) anew under other settings.

    fusion = sum of weight / (rrf_k + rank); beyond `cap` of a file (0: none) items move back; the first `window` are voted on by
    weight / (rrf_k + rerank_rank) if `vote` is given. Adds fusion, verified (the recorded score of these weights) and place.
    """
    part = sum((F.coalesce(F.lit(w) / (rrf_k + F.col(f"{c}_rank")), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    rows = pool.withColumn("fusion", round_half(part, 9)).withColumn("verified", F.col("fusion") == F.col("recorded"))
    of = lambda *o: F.row_number().over(Window.partitionBy("query").orderBy(*o))
    nth = F.row_number().over(Window.partitionBy("query", "file").orderBy(F.desc("fusion"), "item"))
    rows = rows.withColumn("back", (nth > cap).cast("int") if cap else F.lit(0)).withColumn("cut", of("back", F.desc("fusion"), "item"))
    voted = F.col("fusion") + (F.coalesce(F.lit(vote) / (rrf_k + F.col("rerank_rank")), F.lit(0.0)) if vote is not None else F.lit(0.0))
    inside = F.col("cut") <= window
    rows = rows.withColumn("final", F.when(inside, round_half(voted, 9)))
    order = (F.desc_nulls_last("final"), "cut") if vote is not None else ("cut",)
    return rows.withColumn("place", of(*order).cast("long")).select("query", "item", "fusion", "verified", "place")


def reranked(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """(query, item, place): by the reranker's score; a query that it did not score for every item keeps its order. scores: (query, item, score)."""
    rows = ranked.join(scores, ["query", "item"], "left")
    whole = F.count("score").over(Window.partitionBy("query")) == F.count("*").over(Window.partitionBy("query"))
    rows = rows.withColumn("by", F.when(whole, F.col("score")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("by"), "rank")).cast("long")).select("query", "item", "place")


def graded(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(query, ndcg10): results (query, rank, item, slot) name the gold slot they match, or null; gold: (query, slot, gain). A slot pays its first result only."""
    first = results.where("slot IS NOT NULL AND rank <= 10").groupBy("query", "slot").agg(F.min("rank").alias("rank"))
    got = gold.join(first, ["query", "slot"], "left").withColumn("g", F.coalesce(F.col("gain") / F.log2(F.col("rank") + 1), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("gain"), "slot"))
    ideal = got.withColumn("p", place).withColumn("i", F.when(F.col("p") <= 10, F.col("gain") / F.log2(F.col("p") + 1)).otherwise(0.0))
    return ideal.groupBy("query").agg(F.round(F.sum("g") / F.sum("i"), 6).alias("ndcg10"))


def lane(lists: list[DataFrame]) -> DataFrame:
    """(query, item, rank): ranked lists (query, item, rank) one behind the other, numbered anew from 1."""
    rows = None
    for i, d in enumerate(lists):
        part = d.select("query", "item", F.lit(i).alias("list"), F.col("rank").alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("query", "item", F.row_number().over(Window.partitionBy("query").orderBy("list", "r", "item")).cast("long").alias("rank"))


def new_rows(have: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `more` whose key the table does not hold yet, the first of each key."""
    first = Window.partitionBy(*keys).orderBy(*more.columns)
    return more.join(have.select(*keys), keys, "left_anti").withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
