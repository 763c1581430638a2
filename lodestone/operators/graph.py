"""Edges and graph questions: fusion of evidence, co-change, closures, shortest paths, PageRank."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def noisy_or(edges: DataFrame) -> DataFrame:
    """(src, dst, conf, maps): best confidence per map, combined as 1 - product(1 - c); certainty stays certain."""
    best = edges.groupBy("src", "dst", "map").agg(F.max("conf").alias("c"))
    certain = F.max("c") >= 100
    mixed = F.round((1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(99)) / 100)))) * 100, 6)
    return best.groupBy("src", "dst").agg(F.when(certain, 100.0).otherwise(mixed).alias("conf"), F.count("*").alias("maps"))


def best_edge(edges: DataFrame) -> DataFrame:
    order = Window.partitionBy("src", "dst").orderBy(F.desc("conf"), "map", "site")
    return edges.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def top_edges(edges: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy(F.desc("conf"), "dst", "map", "site")
    return edges.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= most)


def arbitrate(edges: DataFrame, authority: str, subordinate: str, most: int = 256) -> DataFrame:
    """A subordinate edge stays if the authority names its destination, or answered nothing (or was cut at `most`) for its source."""
    told = edges.where(F.col("map") == authority).select("src", "dst").distinct()
    answered = told.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") < most).select("src", F.lit(True).alias("answered"))
    sub = edges.where(F.col("map") == subordinate).join(answered, "src", "left").join(told.withColumn("named", F.lit(True)), ["src", "dst"], "left")
    return sub.where(F.col("answered").isNull() | F.col("named")).select("src", "dst", "map", "conf", "site")


def co_change(commit_files: DataFrame, newest: int = 500, most_files: int = 30, least: int = 2) -> DataFrame:
    """(a, b, together, conf): files that change together in the newest commits; commits of many files say nothing."""
    sizes = commit_files.groupBy("commit", "day").agg(F.count("*").alias("n")).orderBy(F.desc("day"), F.desc("commit")).limit(newest)
    rows = commit_files.join(sizes.where(F.col("n") <= most_files).select("commit"), "commit").select("commit", "file")
    per = rows.groupBy("file").agg(F.count("*").alias("of_a"))
    a, b = rows.select("commit", F.col("file").alias("a")), rows.select("commit", F.col("file").alias("b"))
    pairs = a.join(b, "commit").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= least)
    conf = F.greatest(F.lit(1), F.least(F.lit(90), F.floor(90 * F.col("together") / (F.col("of_a") + 1)))).cast("long")
    return pairs.join(per.withColumnRenamed("file", "a"), "a").select("a", "b", "together", conf.alias("conf"))


def touched_by(commit_files: DataFrame, newest: int = 20) -> DataFrame:
    """(file, commit, conf): a file's newest commits, 100 less the place."""
    order = Window.partitionBy("file").orderBy(F.desc("day"), F.desc("commit"))
    rows = commit_files.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < newest)
    return rows.select("file", "commit", (100 - F.col("place")).cast("long").alias("conf"))


def touches(commit_files: DataFrame) -> DataFrame:
    """(commit, file, conf): certain up to eight files, then 800 / files, at least 10.

    Sizes are counted over each commit's own rows, so that the files are not made and shuffled a second time to be joined with them.
    """
    n = F.count("*").over(Window.partitionBy("commit"))
    rows = commit_files.select("commit", "file", n.alias("n"))
    conf = F.when(F.col("n") <= 8, 100).otherwise(F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.lit(800) / F.col("n"))))).cast("long")
    return rows.select("commit", "file", conf.alias("conf"))


def reach(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, hops): least number of hops from any seed, by frontier steps, each stored. Links may repeat.

    A small front goes to the links, which then are only scanned; a large one is joined by a shuffle.
    """
    front = seen = stored(seeds.select("node", F.lit(0).cast("long").alias("hops")).distinct())
    for step in range(1, depth + 1):
        front = stored(_next(links, front, seen).withColumn("hops", F.lit(step).cast("long")))
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen


SMALL = 200_000  # nodes of a front that is broadcast


def small(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.count() <= SMALL else nodes


def _next(links: DataFrame, front: DataFrame, seen: DataFrame) -> DataFrame:
    """(node): where the links of the front lead that was not seen."""
    new = links.join(small(front.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return new.join(small(seen.select("node")), "node", "left_anti")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a checkpoint in the folder that the session names. Only where one machine does all may it be a temporary one."""
    _shared(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a Parquet table in the same folder.

    Unlike a checkpoint it has the size of its files, so that small ones are broadcast, and none of the constraints of its plan: over a
    loop of joins these become filters of nested expressions that double with each step.
    """
    path = f"{_shared(df)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _shared(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def reverse(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def rings(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, ring): who refers to the seeds, and who refers to those but not to the seeds."""
    return reach(reverse(links), seeds, 2).where("hops > 0").select("node", F.col("hops").alias("ring"))


def on_shortest_paths(links: DataFrame, start: DataFrame, end: DataFrame, depth: int) -> DataFrame:
    """(node, hops): nodes on any shortest path from start to end that are at most `depth` from either.

    Layers grow from both sides, always from the smaller front, until two meet; from there the paths are followed back through the layers.
    """
    ways = links, reverse(links)
    layers = [[stored(d.where("node is not null").select("node").distinct())] for d in (start, end)]
    seen, sizes = [layers[0][0], layers[1][0]], [layers[0][0].count(), layers[1][0].count()]
    met = stored(seen[0].join(small(seen[1]), "node", "left_semi"))
    while met.isEmpty():
        open_sides = [i for i in (0, 1) if len(layers[i]) <= depth]
        if not open_sides or not min(sizes):
            return met.select("node", F.lit(0).cast("long").alias("hops"))
        i = min(open_sides, key=lambda i: sizes[i])
        front = stored(_next(ways[i], layers[i][-1], seen[i]))
        layers[i].append(front)
        seen[i], sizes[i] = seen[i].unionByName(front), front.count()
        met = stored(layers[1 - i][-1].join(small(front), "node", "left_semi"))
    here, whole = len(layers[0]) - 1, len(layers[0]) + len(layers[1]) - 2
    found = {here: met}
    for side, step in ((0, -1), (1, 1)):
        for hops in range(here + step, whole + 1 if step > 0 else -1, step):
            if not whole - depth <= hops <= depth:
                break
            last, at = found[hops - step], hops if side == 0 else whole - hops
            near = ways[1 - side].join(small(last.select(F.col("node").alias("src"))), "src", "left_semi").select(F.col("dst").alias("node"))
            found[hops] = stored(near.join(small(layers[side][at]), "node", "left_semi").distinct())
    parts = [d.select("node", F.lit(h).cast("long").alias("hops")) for h, d in found.items() if whole - depth <= h <= depth]
    return reduce(DataFrame.unionByName, parts)


def pagerank(links: DataFrame, jump: DataFrame, rounds: int, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(node, rank): personalised PageRank; what dangling nodes hold goes back to the jump distribution. jump: (node, p), sum 1.

    Stops after `rounds`, or before if the ranks of two rounds differ by less than `tolerance` in all.
    """
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(jump.select("node")).distinct()
    p = nodes.join(jump, "node", "left").select("node", F.coalesce("p", F.lit(0.0)).alias("p"))
    out = links.groupBy("src").agg(F.count("*").alias("n"))
    shares = cut(links.join(out, "src").select("src", "dst", "n"))
    p = cut(p.join(out, F.col("node") == F.col("src"), "left").select("node", "p", F.col("n").isNull().alias("dangling")))
    rank = p.select("node", "p", "dangling", F.col("p").alias("rank"))
    for i in range(rounds):
        flow = shares.join(rank, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        new = (1 - damping) * F.col("p") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") * F.col("p"))
        after = rank.join(flow, "node", "left").crossJoin(F.broadcast(lost)).select("node", "p", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved"))
        if i % 3 == 2 or tolerance is not None:
            after = cut(after)
        rank = after.drop("moved")
        if tolerance is not None and (after.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            break
    return rank.select("node", "rank")
