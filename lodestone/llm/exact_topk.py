"""Exact top-k search by integer inner product, as tiled matrix products.

Query vectors form tiles of bounded size. For each tile, every partition of the candidate table multiplies its
shards by the tile, keeps the k best per query of each shard product (partial selection), and hands on one short
list per query. The lists of partitions merge in a tree, fan_in at a time, so no task meets all lists of a query.
Work is queries x rows, which an exact search can't avoid; a tile is broadcast, its size is fixed by tile_rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import pick, stash, union_all

SCALE = 1024
_LIST = "query_key long, part int, top array<struct<neg:long,vec_id:long>>"


def quantise(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * SCALE)


def usable(df: DataFrame) -> DataFrame:
    """Rows (vec_id, v): vectors that are null, empty or hold null or non-finite components take no part, nor do null ids."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = pick(df, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact scores: in floats while every partial sum fits their 53 bits, else in 64-bit or Python integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    if most < 2**63:
        return queries.astype(np.int64) @ rows.astype(np.int64).T
    big = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in rows], object).T
    return np.clip(big, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query: higher scores first, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= cut
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(df: DataFrame, k: int = 10, query_every: int = 100, tile_rows: int = 4096, fan_in: int = 16, shard_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, fewer if there are fewer.

    Queries are the rows whose vec_id is divisible by query_every; a query's own row is every row with its
    vec_id. Equal query rows count once; two different vectors under one id are two queries and give two lists.
    Repeated candidate rows stay candidates, each in its own place. Vectors are compared with those of equal
    length only. An empty table gives no rows. Scores beyond 64 bits saturate.
    """
    spark, rows = df.sparkSession, usable(df)
    queries = rows.where(F.col("vec_id") % query_every == 0).distinct()
    queries = stash(queries.select(F.monotonically_increasing_id().alias("query_key"), F.col("vec_id").alias("query_id"), "v"))
    parts = rows.rdd.getNumPartitions()
    lists, last = [], -1
    while True:
        tile = queries.where(F.col("query_key") > last).orderBy("query_key").limit(tile_rows).toPandas()
        if tile.empty:
            break
        last = int(tile["query_key"].max())
        packed = spark.sparkContext.broadcast((tile["query_key"].to_numpy(np.int64), tile["query_id"].to_numpy(np.int64), list(tile["v"])))
        lists.append(rows.mapInArrow(_searcher(packed, k, shard_rows), _LIST))
        if len(tile) < tile_rows:
            break
    if not lists:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # partitions of a union are numbered on over its tiles, while the merges count those of one tile
    found = union_all(lists).withColumn("part", F.pmod("part", F.lit(parts)))
    groups = parts
    while groups > 1:
        groups = -(-groups // fan_in)
        found = found.groupBy("query_key", (F.col("part") / fan_in).cast("int").alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    ranked = found.join(queries.select("query_key", "query_id"), "query_key").select("query_id", F.posexplode("top").alias("pos", "t"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.neg")).alias("score"))


def _searcher(tile, k: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, own, vectors = tile.value
        sizes = np.array([len(v) for v in vectors])
        by_size = {n: (np.flatnonzero(sizes == n), quantise(np.stack([np.asarray(v) for v in vectors if len(v) == n]))) for n in np.unique(sizes)}
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in keys]
        for b in batches:
            for lo in range(0, b.num_rows, shard_rows):
                s = b.slice(lo, shard_rows)
                ids, v = s.column(0).to_numpy(zero_copy_only=False), s.column(1)
                lens = np.diff(v.offsets.to_numpy())
                for n, (at, q) in by_size.items():
                    mine = np.flatnonzero(lens == n)
                    if not len(mine):
                        continue
                    flat = v.flatten().to_numpy(zero_copy_only=False)
                    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])[mine]
                    shard = quantise(flat[starts[:, None] + np.arange(n)])
                    scores, cand = _products(q, shard), ids[mine]
                    for row, i in enumerate(at):
                        ok = cand != own[i]
                        sc, cd = (scores[row], cand) if ok.all() else (scores[row][ok], cand[ok])
                        sc, cd = _best(sc, cd, k)
                        best[i] = _best(np.concatenate([best[i][0], sc]), np.concatenate([best[i][1], cd]), k)
        part = TaskContext.get().partitionId()
        rows = [{"query_key": int(q), "part": part, "top": [{"neg": -int(x), "vec_id": int(y)} for x, y in zip(*t, strict=True)]} for q, t in zip(keys, best, strict=True) if len(t[0])]
        if rows:
            kind = pa.schema([("query_key", pa.int64()), ("part", pa.int32()), ("top", pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return run
