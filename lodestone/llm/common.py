"""What the operators of this subpackage share: reading, column picking, shared storage, components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, matched by exact case; other columns may have any names, even clashing ones."""
    have = df.columns
    plain = df.toDF(*[f"__c{i}" for i in range(len(have))])
    return plain.select(*[F.col(f"__c{have.index(n)}").alias(n) for n in names])


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none (single-machine tests) is a local temporary folder set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


def stash(df: DataFrame, **options: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing reads any more. The collection lets Spark's cleaner free the shuffles of plans that are gone."""
    spark = df.sparkSession
    for f in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    spark._jvm.System.gc()


BROADCAST_BYTES = 48 << 20


def checked(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if the bytes of its files are proven small; else as it is, for a shuffled join."""
    spark, size = df.sparkSession, 0
    for f in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if size > limit:
            return df
    return F.broadcast(df)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root) for every node, root the smallest node reached.

    Alternates large-star and small-star rounds, so the number of rounds grows with the logarithm of
    the longest chain. Every round is two aggregations with map-side combine and one join; hubs are left to
    the skew handling of adaptive execution. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    now, state = stash(both), None
    for _ in range(max_rounds):
        # large star: the larger neighbours of a node move to the smallest of its neighbourhood
        around = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = around.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (around.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")))
        large = large.where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of these
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = stash(least.select("v", F.col("m").alias("u")).unionByName(small).distinct())
        sums = after.agg(F.count("*").alias("n"), F.sum(F.hash("v", "u").cast("long")).alias("h")).first()
        now, before, state = after, state, (sums["n"], sums["h"])
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
