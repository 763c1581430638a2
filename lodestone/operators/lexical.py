"""Lexical ranking: BM25 over lines that credit a term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B, DF_CUT, SCORING_TERMS = 1.2, 0.75, 0.25, 12


def credited(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, term, ord, path, line): lines that hold a term of five or more characters. terms: a few dozen rows of one query set."""
    return lines.join(F.broadcast(terms), F.contains(F.lower("line_text"), F.col("term"))).select("query_id", "term", "ord", "path", "line")


def scoring_terms(credits: DataFrame, n_files: DataFrame, cut: float = DF_CUT, most: int = SCORING_TERMS) -> DataFrame:
    """(query_id, term, df, idf): terms of too many files go unless all of a query's do; of the rest the rarest stay."""
    df = credits.groupBy("query_id", "term", "ord").agg(F.countDistinct("path").alias("df")).crossJoin(F.broadcast(n_files))
    common = F.col("df") > cut * F.col("n_files")
    all_common = F.min(common.cast("int")).over(Window.partitionBy("query_id")) == 1
    ranked = df.withColumn("all_common", all_common).where(~common | F.col("all_common"))
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "ord"))).where(F.col("rn") <= most)
    return ranked.select("query_id", "term", "df", F.log((F.col("n_files") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def bm25(lines: DataFrame, chunks: DataFrame, terms: DataFrame, chunk_lines: int = 20, top: int = 8) -> DataFrame:
    """(query_id, rank, path, chunk, score): chunks by BM25, a term's frequency being its credited lines."""
    hits = credited(lines, terms)
    n_files = lines.agg(F.countDistinct("path").alias("n_files"))
    kept = scoring_terms(hits, n_files)
    length = F.greatest("n_lines", F.lit(1)).cast("double")
    average = chunks.agg(F.avg(length).alias("avg_lines"))
    tf = hits.groupBy("query_id", "term", "path", F.floor((F.col("line") - 1) / chunk_lines).alias("chunk")).agg(F.count("*").alias("tf"))
    scored = tf.join(F.broadcast(kept), ["query_id", "term"]).join(chunks, ["path", "chunk"]).crossJoin(F.broadcast(average))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * length / F.col("avg_lines")))
    total = scored.groupBy("query_id", "path", "chunk").agg(F.round(F.sum(part), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "chunk")
    return total.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
