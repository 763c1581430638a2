"""A corpus pipeline: each stage works on what the stage before it kept, written as Parquet and read again.

A row is told by its doc_id and its text, so rows that share a doc_id but not their text are judged each on its own, and rows
that share both share their fate. Null texts count as empty, null ids are ids like any other, an empty table stays empty. Columns
may have any names besides, even names that differ from others in case only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, piece_codec, quality, shingle_sets, substring_dedup
from lodestone.llm.common import checked, pick, stash, table

ORACLE_SQL = None  # the fitted and hashed stages have no SQL form
BATCH_ROWS = 1000  # rows that go to a Python worker at once; texts and whole shingle sets of 10,000 fill an executor beside its heap


def _batched(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with batches of at most BATCH_ROWS rows. The setting stays, as a stage's last step runs after it returns."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(name))
        spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """docs under plain column names, with the key of each row."""
    at = docs.columns.index
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return flat.withColumn("key", _key(F.col(f"c{at('doc_id')}"), F.col(f"c{at('text')}")))


def _key(doc_id: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the key of the row in place of the id."""
    own = pick(docs, "doc_id", "text")
    return own.select(_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")


def _kept(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose key is (left_semi) or is not (left_anti) among keys (found)."""
    return _keyed(docs).join(checked(stash(keys.distinct())), F.col("key") == F.col("found"), how).drop("key").toDF(*docs.columns)


@_batched
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    found = quality.score(_rows(docs), quality.train(docs, table(spark, sf_dir, "labels")))
    return _kept(docs, found.where("not keep").select(F.col("doc_id").alias("found")), "left_anti")


@_batched
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the row with the least id stays (null ids last, then by the row's key), once if it is repeated."""
    found = stash(shingle_sets.near_duplicates(_rows(docs)).withColumnsRenamed({"doc_id": "key", "component_id": "group"}))
    own = pick(docs, "doc_id", "text").select("doc_id", _key(F.col("doc_id"), F.col("text")).alias("own"))
    ids = own.groupBy("own").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    grouped = found.distinct().join(ids, F.col("key") == F.col("own"))
    least = stash(grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "n")).alias("s")).select(F.col("s.key").alias("found"), F.col("s.n").alias("n")))
    once = _kept(docs, least.where("n = 1").select("found"), "left_semi")
    repeated = _keyed(docs).join(checked(stash(least.where("n > 1"))), F.col("key") == F.col("found")).drop("found", "n").dropDuplicates(["key"]).drop("key")
    return once.union(repeated).toDF(*docs.columns)


@_batched
def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose repeated passages; characters that a cut splits are left out. n_chars follows."""
    found = substring_dedup.remove_repeats(docs, texts=True).where("n_removed > 0").dropDuplicates(["doc_id", "source_sha256"])
    left = found.select(F.col("doc_id").alias("cut_id"), "source_sha256", "kept_text")
    names = docs.columns
    own, text, size = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text", "n_chars"))
    same = own.eqNullSafe(F.col("cut_id")) & (F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256) == F.col("source_sha256"))
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    cut = F.col("kept_text")
    new = {"text": F.coalesce(cut, text), "n_chars": F.when(cut.isNull(), size).otherwise(F.length(cut))}
    kinds = dict(zip(names, [f.dataType for f in docs.schema.fields], strict=True))
    return flat.join(left, same, "left").select(*[new[c].cast(kinds[c]).alias(f"c{i}") if c in new else F.col(f"c{i}") for i, c in enumerate(names)]).toDF(*names)


@_batched
def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    found = decontaminate.leaks(_rows(docs), table(spark, sf_dir, "benchmark"))
    return _kept(docs, found.select(F.col("doc_id").alias("found")), "left_anti")


@_batched
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with their byte spans, and the text they decode to."""
    return piece_codec.encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", keep_quality), ("near_dedup", keep_one_of_each_group), ("substring_dedup", remove_repeated_passages), ("decontaminate", remove_leaks), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
