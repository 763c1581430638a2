"""Vector search, rank fusion, per-file caps, interleaving and ordered sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import cut

RRF_K = 60


def nearest(queries: DataFrame, rows: DataFrame, k: int, tile: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): exact neighbours by cosine to six places, ties to the smaller id, a query's own row left out.

    queries: (query_id, q), rows: (vec_id, v), ids long. Queries go to the tasks a tile of fixed size at a time; a task
    multiplies blocks of at most BLOCK scores and keeps the k best for each query, which alone leave it. Null, empty and non-finite vectors take no part.
    """
    ok = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows, held, found = rows.where(ok("v")).select("vec_id", "v"), [], None

    def tile_hits() -> None:
        nonlocal found
        ids, q = np.array([i for i, _ in held], np.int64), np.array([v for _, v in held], np.float64).reshape(len(held), -1 if held else 0)
        sent = rows.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))
        part = rows.mapInArrow(_tile_search(sent, k), "query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
        held.clear()

    for r in queries.where(ok("q")).select("query_id", "q").toLocalIterator():
        held.append((r[0], r[1]))
        if len(held) == tile:
            tile_hits()
    if held or found is None:
        tile_hits()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


BLOCK = 1 << 20  # scores that a task holds at a time


def _tile_search(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, q = sent.value
        step = max(1, BLOCK // max(1, len(q)))
        # the best so far, sorted by place of the query, score and id; least is the score that still counts
        at, best, best_ids, least = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.full(len(q), -2.0)
        for b in batches:
            same = pc.equal(pc.list_value_length(b.column(1)), q.shape[1])
            ids = b.column(0).filter(same).to_numpy(zero_copy_only=False)
            if not len(ids) or not len(q):
                continue
            vectors = b.column(1).filter(same).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for start in range(0, len(ids), step):
                x, own = vectors[start : start + step].astype(np.float64), ids[start : start + step]
                s = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                np.round(s, 6, out=s)
                s[queries[:, None] == own[None, :]] = -np.inf
                if not len(at) and len(own) > k:
                    least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
                i, j = np.nonzero(s >= least[:, None])
                if not len(i):
                    continue
                at, best, best_ids = np.concatenate([at, i]), np.concatenate([best, s[i, j]]), np.concatenate([best_ids, own[j]])
                order = np.lexsort((best_ids, -best, at))
                order = order[np.arange(len(order)) - np.searchsorted(at[order], at[order]) < k]
                at, best, best_ids = at[order], best[order], best_ids[order]
                full = np.flatnonzero(np.arange(len(at)) - np.searchsorted(at, at) == k - 1)
                least[at[full]] = best[full]
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(queries[at]), pa.array(best_ids), pa.array(best)], ["query_id", "vec_id", "score"])

    return run


def fuse(channels: dict[str, tuple[DataFrame, float]], key: list[str], rrf_k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (key, rank): one aggregation, no joins."""
    parts = [d.select(*key, F.lit(name).alias("channel"), (F.lit(w) / (rrf_k + F.col("rank"))).alias("s")) for name, (d, w) in channels.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*key).agg(F.round(F.sum("s"), 9).alias("score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with a rank over all rows: each task numbers a range of the order, and the sizes of the ranges before it are added."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # within a partition the increasing id counts rows in its low 33 bits, above stands the number of the partition
    own = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return own.join(F.broadcast(bases), part == F.col("_part")).withColumn(name, place).drop("_at", "_part", "_base")


def cap_per_file(listed: DataFrame, most: int, file: str = "file", rank: str = "rank") -> DataFrame:
    """Rows beyond `most` of a file move behind all others, in order; none is dropped."""
    if most == 0:
        return listed.withColumn("capped_rank", F.col(rank))
    rows = listed.withColumn("nth", F.row_number().over(Window.partitionBy(file).orderBy(rank)))
    return ranked(rows.withColumn("late", (F.col("nth") > most).cast("int")), "capped_rank", "late", rank).drop("nth", "late")


def interleave(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """One of each list in turn, first sight of a key only, k in all. lists: (key, rank)."""
    rows = None
    for i, d in enumerate(lists):
        part = d.select(key, F.col("rank").alias("turn"), F.lit(i).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key).agg(F.min(F.struct("turn", "list")).alias("at"))
    first = first.orderBy("at.turn", "at.list").limit(k)  # a page of k rows is numbered in one task
    return first.select(key, F.row_number().over(Window.orderBy("at.turn", "at.list")).cast("long").alias("pos"))


def log_odds(items: DataFrame, delivered: DataFrame, sources: DataFrame, silent: float = 3.0) -> DataFrame:
    """Sum of weighted capped logits; a source that says nothing costs `silent` times its weight. sources: a few rows (source, weight)."""
    total = sources.agg(F.sum("weight").alias("all"))
    said = delivered.join(F.broadcast(sources), "source").groupBy("item").agg(F.sum(F.col("weight") * F.col("logit")).alias("said"), F.sum("weight").alias("heard"))
    rows = items.join(said, "item", "left").crossJoin(F.broadcast(total))
    return rows.select("item", F.round(F.coalesce("said", F.lit(0.0)) - silent * (F.col("all") - F.coalesce("heard", F.lit(0.0))), 6).alias("score"))


def union_ordered(lists: list[DataFrame], key: str) -> DataFrame:
    """First-seen order over lists (key, pos)."""
    rows = None
    for i, d in enumerate(lists):
        part = d.select(key, F.struct(F.lit(i).alias("list"), F.col("pos").cast("long").alias("pos")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min("at").alias("at")).select(key, F.col("at.list").cast("long").alias("list"), F.col("at.pos").alias("pos"))


def intersect(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    for o in others:
        first = first.join(o.select(key), key, "left_semi")
    return first


def minus(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    for o in others:
        first = first.join(o.select(key), key, "left_anti")
    return first
