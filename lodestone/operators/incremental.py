"""Snapshots: differences, reuse, fingerprints, and a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state): added, removed, changed or same, by content hash. Both: (path, content_hash)."""
    rows = old.select("path", F.col("content_hash").alias("was")).join(new.select("path", F.col("content_hash").alias("now")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return rows.select("path", state.alias("state"))


def missing_keys(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys to compute, once each."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def apply(old: DataFrame, new: DataFrame, derived_old: DataFrame, derive) -> DataFrame:
    """Rows of derive(new), computed only for files whose hash is new; derive: files (path, content_hash, ...) -> rows with path."""
    d = diff(old, new)
    fresh = new.join(d.where(F.col("state").isin("added", "changed")), "path", "left_semi")
    kept = derived_old.join(d.where(F.col("state") == "same"), "path", "left_semi")
    return kept.unionByName(derive(fresh))


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 over the ordered lines of a manifest; the manifest is one row per file of one workspace."""
    line = F.concat_ws("\0", "path", "content_hash", "language")
    return files.select("workspace", F.struct("path", line.alias("line")).alias("x")).groupBy("workspace").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["line"]), "\n"), 256).alias("fingerprint"))


class VersionedTable:
    """Directories v=<n> and a pointer row; readers pin one version, a writer swaps the pointer after its data is whole."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def version(self) -> int:
        try:
            return self.spark.read.text(f"{self.root}/pointer").agg(F.max(F.col("value").cast("int"))).first()[0] or 0
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v={version or self.version()}")

    def commit(self, df: DataFrame) -> int:
        n = self.version() + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v={n}")
        self.spark.createDataFrame([(str(n),)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/pointer")
        return n
